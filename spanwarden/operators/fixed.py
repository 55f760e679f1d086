"""Names and types that source code uses, as the formats themselves define them."""

from __future__ import annotations

#: Module whose import shows a capability, and its category. The first entry that fits counts.
SECURITY_LIBRARIES = {
    "cryptography": "encryption", "fernet": "encryption", "nacl": "encryption", "pycryptodome": "encryption", "pycrypto": "encryption",
    "Crypto": "encryption", "django_encrypted_model_fields": "encryption", "encrypted_model_fields": "encryption", "django_fernet_fields": "encryption",
    "pgcrypto": "encryption", "hashids": "hashing",
    "bcrypt": "hashing", "argon2": "hashing", "passlib": "hashing", "hashlib": "hashing",
    "jwt": "auth", "jose": "auth", "authlib": "auth", "django.contrib.auth": "auth", "rest_framework.authentication": "auth",
    "rest_framework_simplejwt": "auth", "oauth2_provider": "auth", "social_django": "auth", "allauth": "auth", "dj_rest_auth": "auth",
    "audit_log": "logging", "auditlog": "logging", "django_auditlog": "logging", "axiom": "logging", "sentry_sdk": "logging",
    "structlog": "logging", "logging": "logging",
}

#: Other languages' imports (pattern, category, name), searched in every file.
IMPORT_PATTERNS = (
    (r"""require\s*\(\s*['"]bcrypt['"]\s*\)|from\s+['"]bcrypt['"]""", "hashing", "bcrypt"),
    (r"""require\s*\(\s*['"]argon2['"]\s*\)|from\s+['"]argon2['"]""", "hashing", "argon2"),
    (r"""require\s*\(\s*['"]jsonwebtoken['"]\s*\)|from\s+['"]jsonwebtoken['"]""", "auth", "jsonwebtoken"),
    (r"""require\s*\(\s*['"]passport['"]\s*\)|from\s+['"]passport['"]""", "auth", "passport"),
    (r"""require\s*\(\s*['"]helmet['"]\s*\)|from\s+['"]helmet['"]""", "security", "helmet"),
    (r"""require\s*\(\s*['"]cors['"]\s*\)|from\s+['"]cors['"]""", "security", "cors"),
    (r"""require\s*\(\s*['"]crypto['"]\s*\)|from\s+['"]crypto['"]""", "encryption", "crypto"),
    (r"""require\s*\(\s*['"]winston['"]\s*\)|from\s+['"]winston['"]""", "logging", "winston"),
    (r"""require\s*\(\s*['"]pino['"]\s*\)|from\s+['"]pino['"]""", "logging", "pino"),
    (r"import\s+org\.springframework\.security", "auth", "spring-security"),
    (r"import\s+io\.jsonwebtoken", "auth", "jjwt"),
    (r"import\s+javax\.crypto", "encryption", "javax.crypto"),
    (r"import\s+org\.bouncycastle", "encryption", "bouncycastle"),
    (r"import\s+org\.slf4j", "logging", "slf4j"),
    (r"import\s+ch\.qos\.logback", "logging", "logback"),
    (r"require\s+['\"]bcrypt['\"]", "hashing", "bcrypt"),
    (r"require\s+['\"]jwt['\"]", "auth", "jwt"),
    (r"require\s+['\"]devise['\"]|gem\s+['\"]devise['\"]", "auth", "devise"),
    (r"require\s+['\"]openssl['\"]", "encryption", "openssl"),
    (r'"golang\.org/x/crypto"', "encryption", "x/crypto"),
    (r'"github\.com/golang-jwt/jwt"', "auth", "golang-jwt"),
    (r'"go\.uber\.org/zap"', "logging", "zap"),
    (r'"github\.com/sirupsen/logrus"', "logging", "logrus"),
    (r"use\s+Illuminate\\Hashing", "hashing", "laravel-hashing"),
    (r"use\s+Illuminate\\Auth", "auth", "laravel-auth"),
    (r"use\s+Illuminate\\Encryption", "encryption", "laravel-encryption"),
    (r"use\s+Monolog\\", "logging", "monolog"),
    (r"using\s+Microsoft\.AspNetCore\.Identity", "auth", "aspnet-identity"),
    (r"using\s+System\.Security\.Cryptography", "encryption", "system-crypto"),
    (r"using\s+Microsoft\.Extensions\.Logging", "logging", "ms-logging"),
    (r"using\s+Serilog", "logging", "serilog"),
)

#: A field's type in its own language or framework to a Python type; other types stay as they are.
FIELD_TYPES = {
    "django": {
        "CharField": "str", "TextField": "str", "EmailField": "str", "URLField": "str", "SlugField": "str", "UUIDField": "UUID", "IntegerField": "int",
        "BigIntegerField": "int", "SmallIntegerField": "int", "PositiveIntegerField": "int", "FloatField": "float", "DecimalField": "Decimal",
        "BooleanField": "bool", "NullBooleanField": "bool | None", "DateField": "date", "DateTimeField": "datetime", "TimeField": "time",
        "DurationField": "timedelta", "BinaryField": "bytes", "JSONField": "Any", "ArrayField": "list", "HStoreField": "dict", "ForeignKey": "int",
        "OneToOneField": "int", "ManyToManyField": "list", "FileField": "str", "ImageField": "str", "GenericIPAddressField": "str", "IPAddressField": "str",
        "EncryptedCharField": "str", "EncryptedTextField": "str", "EncryptedEmailField": "str", "EncryptedIntegerField": "int",
        "EncryptedDateField": "date", "EncryptedDateTimeField": "datetime",
    },
    "prisma": {"String": "str", "Int": "int", "Float": "float", "Boolean": "bool", "DateTime": "datetime", "Decimal": "Decimal", "BigInt": "int", "Json": "Any", "Bytes": "bytes"},
    "sequelize": {
        "STRING": "str", "TEXT": "str", "INTEGER": "int", "BIGINT": "int", "FLOAT": "float", "DOUBLE": "float", "DECIMAL": "Decimal", "BOOLEAN": "bool",
        "DATE": "datetime", "DATEONLY": "date", "UUID": "UUID", "JSON": "Any", "JSONB": "Any", "BLOB": "bytes", "ENUM": "str", "ARRAY": "list",
    },
    "java": {
        "String": "str", "Integer": "int", "int": "int", "Long": "int", "long": "int", "Double": "float", "double": "float", "Float": "float", "float": "float",
        "Boolean": "bool", "boolean": "bool", "BigDecimal": "Decimal", "Date": "date", "LocalDate": "date", "LocalDateTime": "datetime", "Instant": "datetime",
        "UUID": "UUID", "byte[]": "bytes",
    },
    "rails": {
        "string": "str", "text": "str", "integer": "int", "bigint": "int", "float": "float", "decimal": "Decimal", "boolean": "bool", "date": "date",
        "datetime": "datetime", "timestamp": "datetime", "binary": "bytes", "json": "Any", "jsonb": "Any", "uuid": "UUID", "inet": "str", "cidr": "str",
    },
    "go": {
        "string": "str", "int": "int", "int32": "int", "int64": "int", "uint": "int", "uint32": "int", "uint64": "int", "float32": "float", "float64": "float",
        "bool": "bool", "time.Time": "datetime", "*time.Time": "datetime", "[]byte": "bytes", "uuid.UUID": "UUID",
    },
    "laravel": {
        "string": "str", "text": "str", "longText": "str", "mediumText": "str", "integer": "int", "bigInteger": "int", "smallInteger": "int", "tinyInteger": "int",
        "unsignedBigInteger": "int", "float": "float", "double": "float", "decimal": "Decimal", "boolean": "bool", "date": "date", "dateTime": "datetime",
        "timestamp": "datetime", "time": "time", "binary": "bytes", "json": "Any", "jsonb": "Any", "uuid": "UUID", "char": "str", "enum": "str",
    },
    "csharp": {
        "string": "str", "int": "int", "long": "int", "short": "int", "double": "float", "float": "float", "decimal": "Decimal", "bool": "bool",
        "DateTime": "datetime", "DateTimeOffset": "datetime", "Guid": "UUID", "byte[]": "bytes",
    },
    "rust": {
        "String": "str", "i32": "int", "i64": "int", "u32": "int", "u64": "int", "f32": "float", "f64": "float", "bool": "bool",
        "NaiveDateTime": "datetime", "NaiveDate": "date", "Uuid": "UUID", "Vec<u8>": "bytes",
    },
}
#: Which of these a file's suffix stands for.
TYPES_OF_SUFFIX = {".py": "django", ".prisma": "prisma", ".js": "sequelize", ".jsx": "sequelize", ".ts": "sequelize", ".tsx": "sequelize", ".java": "java", ".rb": "rails", ".go": "go", ".php": "laravel", ".cs": "csharp", ".rs": "rust"}

#: Field classes that encrypt.
ENCRYPTED_FIELDS = ("EncryptedCharField", "EncryptedTextField", "EncryptedEmailField", "EncryptedIntegerField", "EncryptedDateField", "EncryptedDateTimeField", "FernetField", "pgp_sym_encrypt", "EncryptedField")

#: The actions on delete, in the order in which they are looked for.
CASCADES = ("CASCADE", "SET_NULL", "SET_DEFAULT", "PROTECT", "DO_NOTHING", "RESTRICT", "UNKNOWN")

#: What Rails' ``dependent`` option does.
DEPENDENT = {"destroy": "CASCADE", "delete_all": "CASCADE", "nullify": "SET_NULL", "restrict_with_error": "PROTECT", "restrict_with_exception": "PROTECT"}

#: Folders that hold no source of one's own, for the walk of Python and of other languages.
PYTHON_SKIP_DIRS = ("migrations", "__pycache__", ".git", ".tox", ".venv", "venv", "env", "node_modules", "dist", "build", ".mypy_cache", ".pytest_cache", "htmlcov", "docs")
SKIP_DIRS = (
    "node_modules", "vendor", "dist", "build", ".git", "__pycache__", ".tox", ".venv", "venv", "env", ".mypy_cache", ".pytest_cache", "htmlcov", ".next",
    ".nuxt", "coverage", "target", "bin", "obj", ".gradle", ".idea", ".vscode", "tmp", "temp", "log", "logs", "public", "static", "assets", "migrations", ".svn",
)

#: Packages that show how a Python service signs in, and settings that name its way.
JWT_PACKAGES = ("djangorestframework-simplejwt", "pyjwt", "python-jose")
OAUTH_PACKAGES = ("django-oauth-toolkit", "authlib", "social-auth-app-django")
AUTHENTICATION = ("SessionAuthentication", "TokenAuthentication", "JWTAuthentication", "BasicAuthentication")
