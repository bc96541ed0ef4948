"""Knowledge tables that classify libraries, types, receivers and statuses (fixed values)."""

# Fixed values: (needle, category, technology) of known libraries; the first match wins.
LIBRARY_CATALOG = (
    # databases
    ("spring-boot-starter-data-jpa", "database", "JPA / Hibernate"),
    ("spring-boot-starter-data-jdbc", "database", "Spring Data JDBC"),
    ("spring-boot-starter-jdbc", "database", "JDBC"),
    ("spring-boot-starter-data-r2dbc", "database", "R2DBC"),
    ("spring-boot-starter-data-mongodb", "database", "MongoDB"),
    ("spring-boot-starter-data-cassandra", "database", "Cassandra"),
    ("spring-boot-starter-data-neo4j", "database", "Neo4j"),
    ("spring-boot-starter-data-elasticsearch", "search", "Elasticsearch"),
    ("spring-boot-starter-data-couchbase", "database", "Couchbase"),
    ("postgresql", "database", "PostgreSQL"),
    ("r2dbc-postgresql", "database", "PostgreSQL"),
    ("mysql-connector", "database", "MySQL"),
    ("mariadb", "database", "MariaDB"),
    ("ojdbc", "database", "Oracle"),
    ("mssql-jdbc", "database", "SQL Server"),
    ("h2", "database", "H2"),
    ("hsqldb", "database", "HSQLDB"),
    ("derby", "database", "Derby"),
    ("sqlite-jdbc", "database", "SQLite"),
    ("mongodb-driver", "database", "MongoDB"),
    ("dynamodb", "database", "DynamoDB"),
    ("hibernate-core", "database", "Hibernate"),
    ("mybatis", "database", "MyBatis"),
    ("jooq", "database", "jOOQ"),
    ("flyway", "db-migration", "Flyway"),
    ("liquibase", "db-migration", "Liquibase"),
    ("elasticsearch", "search", "Elasticsearch"),
    ("opensearch", "search", "OpenSearch"),
    ("solr", "search", "Solr"),
    # caches
    ("spring-boot-starter-data-redis", "cache", "Redis"),
    ("redisson", "cache", "Redis (Redisson)"),
    ("jedis", "cache", "Redis (Jedis)"),
    ("lettuce", "cache", "Redis (Lettuce)"),
    ("spring-boot-starter-cache", "cache", "Spring Cache"),
    ("caffeine", "cache", "Caffeine"),
    ("ehcache", "cache", "Ehcache"),
    ("hazelcast", "cache", "Hazelcast"),
    ("memcached", "cache", "Memcached"),
    # messaging
    ("spring-kafka", "messaging", "Kafka"),
    ("kafka-clients", "messaging", "Kafka"),
    ("spring-cloud-stream-binder-kafka", "messaging", "Kafka (Spring Cloud Stream)"),
    ("spring-cloud-stream-binder-rabbit", "messaging", "RabbitMQ (Spring Cloud Stream)"),
    ("spring-cloud-stream", "messaging", "Spring Cloud Stream"),
    ("spring-boot-starter-amqp", "messaging", "RabbitMQ"),
    ("spring-rabbit", "messaging", "RabbitMQ"),
    ("activemq", "messaging", "ActiveMQ"),
    ("artemis", "messaging", "ActiveMQ Artemis"),
    ("spring-jms", "messaging", "JMS"),
    ("spring-cloud-aws-messaging", "messaging", "AWS SQS/SNS"),
    ("spring-cloud-aws-starter-sqs", "messaging", "AWS SQS"),
    ("sqs", "messaging", "AWS SQS"),
    ("sns", "messaging", "AWS SNS"),
    ("pulsar", "messaging", "Pulsar"),
    ("google-cloud-pubsub", "messaging", "Google Pub/Sub"),
    ("azure-servicebus", "messaging", "Azure Service Bus"),
    ("nats", "messaging", "NATS"),
    # http and rpc clients
    ("spring-cloud-starter-openfeign", "http-client", "OpenFeign"),
    ("feign", "http-client", "Feign"),
    ("spring-boot-starter-webflux", "web", "Spring WebFlux / WebClient"),
    ("okhttp", "http-client", "OkHttp"),
    ("httpclient5", "http-client", "Apache HttpClient 5"),
    ("httpclient", "http-client", "Apache HttpClient"),
    ("retrofit", "http-client", "Retrofit"),
    ("grpc", "rpc", "gRPC"),
    ("graphql", "api", "GraphQL"),
    ("spring-ws", "api", "SOAP (Spring WS)"),
    ("cxf", "api", "SOAP (CXF)"),
    # cloud and infrastructure
    ("spring-cloud-starter-netflix-eureka-server", "service-discovery", "Eureka Server"),
    ("spring-cloud-starter-netflix-eureka-client", "service-discovery", "Eureka Client"),
    ("spring-cloud-starter-consul", "service-discovery", "Consul"),
    ("spring-cloud-kubernetes", "service-discovery", "Kubernetes"),
    ("spring-cloud-config-server", "configuration", "Spring Cloud Config Server"),
    ("spring-cloud-starter-config", "configuration", "Spring Cloud Config Client"),
    ("spring-cloud-config-client", "configuration", "Spring Cloud Config Client"),
    ("spring-cloud-starter-vault", "configuration", "Vault"),
    ("spring-cloud-starter-gateway", "api-gateway", "Spring Cloud Gateway"),
    ("zuul", "api-gateway", "Netflix Zuul"),
    ("spring-cloud-starter-loadbalancer", "load-balancing", "Spring Cloud LoadBalancer"),
    ("ribbon", "load-balancing", "Ribbon"),
    ("resilience4j", "resilience", "Resilience4j"),
    ("hystrix", "resilience", "Hystrix"),
    ("spring-cloud-starter-circuitbreaker", "resilience", "Spring Cloud Circuit Breaker"),
    ("spring-boot-admin", "observability", "Spring Boot Admin"),
    ("spring-boot-starter-actuator", "observability", "Actuator"),
    ("micrometer-registry-prometheus", "observability", "Prometheus"),
    ("micrometer-tracing", "observability", "Micrometer Tracing"),
    ("zipkin", "observability", "Zipkin"),
    ("sleuth", "observability", "Sleuth"),
    ("opentelemetry", "observability", "OpenTelemetry"),
    ("logstash", "observability", "Logstash"),
    ("aws-java-sdk-s3", "storage", "AWS S3"),
    ("software.amazon.awssdk:s3", "storage", "AWS S3"),
    ("google-cloud-storage", "storage", "Google Cloud Storage"),
    ("azure-storage", "storage", "Azure Storage"),
    ("minio", "storage", "MinIO"),
    ("spring-boot-starter-mail", "email", "JavaMail"),
    ("sendgrid", "email", "SendGrid"),
    ("twilio", "notification", "Twilio"),
    ("stripe", "payment", "Stripe"),
    ("quartz", "scheduling", "Quartz"),
    ("spring-boot-starter-batch", "batch", "Spring Batch"),
    ("shedlock", "scheduling", "ShedLock"),
    # security
    ("spring-boot-starter-oauth2-resource-server", "security", "OAuth2 Resource Server"),
    ("spring-boot-starter-oauth2-client", "security", "OAuth2 Client"),
    ("spring-security-oauth2", "security", "OAuth2"),
    ("spring-cloud-starter-oauth2", "security", "OAuth2"),
    ("spring-boot-starter-security", "security", "Spring Security"),
    ("keycloak", "security", "Keycloak"),
    ("jjwt", "security", "JWT (jjwt)"),
    ("java-jwt", "security", "JWT"),
    ("nimbus-jose-jwt", "security", "JWT (Nimbus)"),
    # web, api docs and others
    ("spring-boot-starter-web", "web", "Spring MVC"),
    ("spring-boot-starter-thymeleaf", "web-ui", "Thymeleaf"),
    ("spring-boot-starter-validation", "validation", "Bean Validation"),
    ("springdoc-openapi", "api-docs", "OpenAPI (springdoc)"),
    ("springfox", "api-docs", "Swagger (springfox)"),
    ("swagger", "api-docs", "Swagger"),
    ("lombok", "code-generation", "Lombok"),
    ("mapstruct", "code-generation", "MapStruct"),
    ("spring-boot-starter-test", "test", "Spring Boot Test"),
    ("junit", "test", "JUnit"),
    ("mockito", "test", "Mockito"),
    ("testcontainers", "test", "Testcontainers"),
)

# Fixed values: (annotation, stereotype, layer), the first annotation a type has wins.
STEREOTYPES = (
    ("RestController", "rest_controller", "web"),
    ("Controller", "controller", "web"),
    ("RestControllerAdvice", "controller_advice", "web"),
    ("ControllerAdvice", "controller_advice", "web"),
    ("FeignClient", "feign_client", "integration"),
    ("Repository", "repository", "data"),
    ("Service", "service", "service"),
    ("Configuration", "configuration", "config"),
    ("SpringBootApplication", "application", "config"),
    ("ConfigurationProperties", "configuration_properties", "config"),
    ("Entity", "entity", "domain"),
    ("Document", "document", "domain"),
    ("Table", "entity", "domain"),
    ("Embeddable", "embeddable", "domain"),
    ("MappedSuperclass", "entity", "domain"),
    ("RedisHash", "entity", "domain"),
    ("Mapper", "mapper", "service"),
    ("Component", "component", "service"),
)

# Base interfaces of repositories.
REPOSITORY_BASES = (
    "JpaRepository", "JpaSpecificationExecutor", "QuerydslPredicateExecutor", "RevisionRepository", "MongoRepository",
    "ReactiveMongoRepository", "R2dbcRepository", "ElasticsearchRepository", "CassandraRepository", "ReactiveCassandraRepository",
    "Neo4jRepository", "ReactiveNeo4jRepository", "CouchbaseRepository", "KeyValueRepository", "CrudRepository", "ListCrudRepository",
    "PagingAndSortingRepository", "ListPagingAndSortingRepository", "ReactiveCrudRepository", "ReactiveSortingRepository", "Repository",
)
LISTENER_ANNOTATIONS = ("KafkaListener", "RabbitListener", "JmsListener", "SqsListener", "StreamListener")
DTO_SUFFIXES = ("Dto", "DTO", "Request", "Response", "Payload", "Event", "Message", "Command", "Resource", "View", "Form")
ACCESSOR_NAME = "^(get|set|is|has|with|equals|hashCode|toString|builder|of|from|compareTo)"
DATA_STEREOTYPES = ("dto", "entity", "document", "embeddable", "enum", "exception")

# Integration category of receivers without rules of their own.
GENERIC_CLIENTS = {
    "r2dbc": "database", "dynamodb": "database", "elasticsearch": "search", "hazelcast": "cache", "local_cache": "cache",
    "email": "email", "s3": "storage", "gcs": "storage", "azure_blob": "storage", "websocket": "messaging", "pubsub": "messaging",
}

# HTTP verb of REST template calls.
REST_TEMPLATE_VERBS = {
    "getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST",
    "put": "PUT", "patchForObject": "PATCH", "delete": "DELETE", "headForHeaders": "HEAD", "optionsForAllow": "OPTIONS",
}

# Request mappings and their verb (None: given by the annotation).
MAPPING_VERBS = {
    "RequestMapping": None, "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH",
}

# SQL first words and the operation they are.
SQL_OPERATIONS = {
    "SELECT": "READ", "WITH": "READ", "FROM": "READ", "INSERT": "WRITE", "UPDATE": "WRITE", "MERGE": "WRITE", "UPSERT": "WRITE",
    "REPLACE": "WRITE", "DELETE": "DELETE", "CALL": "CALL", "EXEC": "CALL", "EXECUTE": "CALL", "TRUNCATE": "DELETE",
}

# Statuses of well-known exceptions.
KNOWN_EXCEPTION_STATUS = {
    "MethodArgumentNotValidException": 400, "ConstraintViolationException": 400, "HttpMessageNotReadableException": 400,
    "MissingServletRequestParameterException": 400, "MethodArgumentTypeMismatchException": 400, "AccessDeniedException": 403,
    "AuthenticationException": 401, "BadCredentialsException": 401, "UsernameNotFoundException": 401, "EntityNotFoundException": 404,
    "EmptyResultDataAccessException": 404, "NoSuchElementException": 404, "DataIntegrityViolationException": 409,
    "OptimisticLockingFailureException": 409, "HttpRequestMethodNotSupportedException": 405, "HttpMediaTypeNotSupportedException": 415,
}

# Parameter annotations and the location they stand for, in order of precedence.
PARAM_LOCATIONS = (
    ("PathVariable", "path"), ("RequestParam", "query"), ("RequestHeader", "header"), ("CookieValue", "cookie"),
    ("RequestBody", "body"), ("RequestPart", "multipart"), ("ModelAttribute", "model"), ("MatrixVariable", "matrix"),
)
PAGEABLE_PARAMS = (("page", "int"), ("size", "int"), ("sort", "String"))
FRAMEWORK_PARAM_ANNOTATIONS = ("AuthenticationPrincipal", "CurrentSecurityContext")
FRAMEWORK_PARAM_TYPES = (
    "HttpServletRequest", "HttpServletResponse", "ServletRequest", "ServletResponse", "HttpSession", "WebRequest",
    "NativeWebRequest", "ServerWebExchange", "ServerHttpRequest", "ServerHttpResponse", "Model", "ModelMap", "ModelAndView",
    "BindingResult", "Errors", "RedirectAttributes", "SessionStatus", "Locale", "TimeZone", "ZoneId", "Principal",
    "Authentication", "UriComponentsBuilder", "HttpHeaders", "HttpEntity", "InputStream", "OutputStream", "Reader", "Writer",
    "SseEmitter", "Jwt", "OAuth2User", "OidcUser",
)
SIMPLE_TYPES = (
    "String", "CharSequence", "Integer", "Long", "Short", "Byte", "Double", "Float", "Boolean", "Character", "BigDecimal",
    "BigInteger", "Number", "UUID", "Date", "LocalDate", "LocalDateTime", "LocalTime", "Instant", "OffsetDateTime",
    "ZonedDateTime", "Duration", "Period", "YearMonth", "Year", "Object", "URI", "URL", "byte", "short", "int", "long",
    "float", "double", "boolean", "char", "MultipartFile", "Part", "Resource", "byte[]",
)
# Wrapper, collection and map types a schema looks through.
WRAPPER_TYPES = (
    "Optional", "ResponseEntity", "Mono", "CompletableFuture", "Future", "Callable", "DeferredResult", "HttpEntity", "EntityModel",
    "CompletionStage", "ListenableFuture",
)
COLLECTION_TYPES = (
    "List", "Set", "Collection", "Iterable", "SortedSet", "LinkedList", "ArrayList", "HashSet", "LinkedHashSet", "TreeSet",
    "Queue", "Deque", "Stream", "Flux", "Page", "Slice",
)
MAP_TYPES = ("Map", "HashMap", "LinkedHashMap", "TreeMap", "SortedMap", "ConcurrentMap", "MultiValueMap")
VALIDATION_ANNOTATIONS = (
    "NotNull", "NotEmpty", "NotBlank", "Null", "Size", "Min", "Max", "DecimalMin", "DecimalMax", "Digits", "Email", "Pattern",
    "Positive", "PositiveOrZero", "Negative", "NegativeOrZero", "Past", "PastOrPresent", "Future", "FutureOrPresent",
    "AssertTrue", "AssertFalse", "Length", "Range", "URL", "Valid",
)
INJECTION_ANNOTATIONS = ("Autowired", "Inject", "Resource")

# Messages clients send, by receiver kind: call name pattern, technology, place of the destination
# argument, and the least number of arguments for that place to be the destination.
MESSAGE_CALLS = (
    ("kafka", "^(send|sendDefault|sendOffsetsToTransaction)$", "kafka", 0, 1),
    ("rabbitmq", "^(convertAndSend|send|convertSendAndReceive|sendAndReceive)", "rabbitmq", 0, 2),
    ("jms", "^(convertAndSend|send)", "jms", 0, 2),
    ("stream", "^send$", "stream", 0, 1),
    ("sqs", "^(send|convertAndSend)", "sqs", 0, 2),
    ("sns", "^(publish|send|sendNotification|convertAndSend)$", "sns", 0, 2),
    ("redis", "^(convertAndSend|publish)$", "redis-pubsub", 0, 1),
    ("websocket", "", "websocket", 0, 1),
    ("pubsub", "", "pubsub", 0, 1),
)

# Listener annotations, technology, and the arguments that name destinations.
LISTENER_RULES = (
    ("KafkaListener", "kafka", ("topics", "value", "topicPattern")),
    ("RabbitListener", "rabbitmq", ("queues", "value", "queuesToDeclare")),
    ("JmsListener", "jms", ("destination",)),
    ("SqsListener", "sqs", ("value", "queueNames")),
    ("StreamListener", "stream", ("value", "target")),
    ("PulsarListener", "pulsar", ("topics", "value")),
    ("EventListener", "spring-event", ("value", "classes")),
    ("TransactionalEventListener", "spring-event", ("value", "classes")),
)
SCHEDULE_KEYS = ("cron", "fixedRate", "fixedDelay", "initialDelay", "fixedRateString", "fixedDelayString", "zone")
