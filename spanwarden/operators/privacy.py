"""Privacy analysis: structural tables joined with classified fields, one row per section.

``code`` is a dict of DataFrames: models, fields, endpoints, delete_paths, libraries, files. ``pii`` has the columns of
``PII_FIELDS`` plus nothing else. Every section is a one-row DataFrame of the same schema, so the report is their union.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored

PERSONAL = ("PII", "SENSITIVE_PII")
#: Fixed values that the sections look for.
RETENTION_FIELDS = ("expires_at", "expiry_date", "expiry", "retention_period", "retention_days", "ttl", "valid_until", "valid_till", "purge_after", "auto_delete_at", "delete_after", "data_retention", "retention_end")
RETENTION_POLICY = (r"retention.?policy|data.?retention", r"auto.?purge|auto.?delete|auto.?cleanup", r"scheduled.?deletion|periodic.?deletion", r"cleanup.?task|purge.?task|delete.?old|remove.?expired", r"RETENTION_DAYS|RETENTION_PERIOD|DATA_TTL")
SCHEDULERS = (r"celery.?beat|periodic.?task|crontab|beat_schedule", r"@periodic_task|@app\.task.*schedule")
ALERTING = ("sentry_sdk", "sentry", "raven", "pagerduty", "opsgenie", "datadog", "newrelic", "rollbar", "bugsnag", "airbrake")
MANAGEMENT = (r"class Command\(BaseCommand\)", r"management/commands/")
NOTIFICATION = (r"send_mail|EmailMessage|notify_admins",)
EXTERNAL_CALLS = (r"https?://[a-zA-Z0-9.-]+\.(?:com|io|net|org)/api", r"EXTERNAL_API|THIRD_PARTY_URL|WEBHOOK_URL")
BREACH = (r"breach", r"incident.?response", r"data.?breach.?notif", r"notify.?board|notify.?dpa|notify.?authority", r"BreachNotification|DataBreach")
AUDIT_MODELS = (r"AuditLog|audit_log", r"AccessLog|access_log", r"DataAccessLog", r"security_event|SecurityEvent")
AGE_FIELDS = ("date_of_birth", "dob", "birth_date", "birthdate", "age", "year_of_birth", "birth_year")
CHILD_MODELS = ("child", "minor", "juvenile", "kid", "infant", "pediatric", "paediatric")
CHILD = (r"child|minor|juvenile|under.?age|underage", r"parental.?consent|guardian.?consent", r"age.?gate|age.?check|age.?verif|verify.?age|min.?age", r"is.?child|is.?minor")
AGE_GATE = (r"age\s*[<>=!]+\s*1[0-8]", r"years?\s*[<>=!]+\s*1[0-8]", r"MIN_AGE|MINIMUM_AGE|CHILD_AGE", r"if.*age.*(?:18|fourteen|sixteen|thirteen)", r"timedelta.*days.*(?:6570|6574)")
CONSENT = (r"consent", r"data_processing_consent", r"consent_given", r"has_consented", r"consent_required", r"ConsentMiddleware", r"require_consent")
INDIAN_REGIONS = ("ap-south-1", "ap-south-2", "asia-south1", "asia-south2", "centralindia", "southindia", "westindia", "jioindiawest", "jioindiacentral")
REGIONS = (r"AWS_REGION|AWS_DEFAULT_REGION|REGION_NAME", r"ap-south-[12]", r"asia-south[12]", r"centralindia|southindia|westindia|jioindia", r"GOOGLE_CLOUD_REGION|GCP_REGION|AZURE_REGION")
FOREIGN_REGIONS = r"us-east|us-west|eu-west|eu-central|ap-northeast|ap-southeast|sa-east|ca-central|me-south|af-south|us-gov|europe-west|europe-north|northeurope|westeurope|eastus|westus|northcentralus|southcentralus"
STORAGE = (r"S3Boto3Storage|AWS_S3|boto3|s3_bucket", r"google.cloud.storage|GCS_BUCKET", r"azure.storage.blob|AZURE_CONTAINER", r"DEFAULT_FILE_STORAGE|STATICFILES_STORAGE")
DATABASES = (r"DATABASE_URL|DB_HOST|DATABASES", r"\.rds\.amazonaws\.com", r"\.sql\.gcp\.", r"\.database\.azure\.com", r"\.mongodb\.net")

SETTINGS_PATH = r"(?:^|/)settings[^/]*[.]py$|(?:^|/)settings/(?:.*/)?[^/]*[.]py$"

CLASSES = ("PII", "SENSITIVE_PII", "INDIRECT", "NOT_PII")
#: What a recorded classification says of a batch of models.
ANSWER = (
    "models array<struct<model_name:string,fields:array<struct<field_name:string,classification:string,reason:string>>>>, "
    "aadhaar_fields array<string>, financial_fields array<string>, health_fields array<string>, children_data_risk boolean"
)
MODELS_A_BATCH = 25

Section = Callable[[dict[str, DataFrame], DataFrame], DataFrame]


def _hit(patterns: tuple[str, ...], content: Column) -> Column:
    """The first pattern's leftmost match as "line: match", the line counted by line feeds; null without one."""
    found = F.filter(F.array(*[F.regexp_extract(content, f"(?i){p}", 0) for p in patterns]), lambda m: m != "")
    # places by instr count characters; those of regexp_instr count halves of characters beyond the first plane
    before = lambda m: F.left(content, F.instr(content, m) - 1)
    line = lambda m: F.length(before(m)) - F.length(F.replace(before(m), F.lit("\n"), F.lit(""))) + 1
    return F.get(F.transform(F.slice(found, 1, 1), lambda m: F.concat(line(m).cast("string"), F.lit(": "), m)), F.lit(0))


def evidence(files: DataFrame, families: dict[str, tuple[str, ...]], python_only: bool = True) -> DataFrame:
    """file_path and, for each family, its first match in the file: one pass over the files for all families.

    The matches are an array that is exploded, so that the test for any match reads them and does not search the files again.
    """
    rows = files.filter(F.col("file_path").endswith(".py")) if python_only else files
    found = F.array(F.struct(*[_hit(p, F.col("content")).alias(name) for name, p in families.items()]))
    return rows.select("file_path", F.inline(F.filter(found, lambda x: reduce(lambda a, b: a | b, [x[n].isNotNull() for n in families]))))


def pii_models(pii: DataFrame) -> DataFrame:
    return pii.filter(F.col("classification").isin(*PERSONAL)).groupBy("model").agg(F.bool_or(F.col("classification") == "SENSITIVE_PII").alias("has_sensitive"), F.count(F.lit(1)).alias("n_fields"))


def normalise_classification(c: Column) -> Column:
    said = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("_"))
    return F.when(said.isin("PII", "SENSITIVE_PII", "INDIRECT", "NOT_PII"), said).otherwise("NOT_PII")


def cache_key(root: Column, sha: Column) -> Column:
    """16 hex digits that name a repository at a commit."""
    return F.substring(F.sha2(F.concat(root, F.lit(":"), F.coalesce(sha, F.lit("unknown"))), 256), 1, 16)


def field_line(fields: DataFrame) -> Column:
    """A field as it is shown to a classifier: type, length, whether it may be null, what it points to, whether it is encrypted."""
    action = F.coalesce(F.concat(F.lit(" (on_delete="), "on_delete", F.lit(")")), F.lit("")) if "on_delete" in fields.columns else F.lit("")
    marks = (
        F.coalesce(F.concat(F.lit(" max_length="), F.col("max_length").cast("string")), F.lit("")),
        F.when(F.col("is_nullable"), " nullable").otherwise(""),
        F.coalesce(F.concat(F.lit(" -> "), "related_model", action), F.lit("")),
        F.when(F.col("is_encrypted"), " [ENCRYPTED]").otherwise(""),
    )
    return F.concat(F.lit("- "), "name", F.lit(": "), "field_type", *marks)


def model_batches(models: DataFrame, fields: DataFrame, size: int = MODELS_A_BATCH) -> DataFrame:
    """batch (from 1), place, model, said: the models that have fields, in the order of their files, so many to a batch."""
    from .reports import with_place

    said = fields.select(F.col("model").alias("rule_id"), "file", F.struct("line", field_line(fields).alias("l")).alias("l"))
    said = said.groupBy("rule_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["l"]), "\n").alias("said"))
    rows = models.select(F.col("name").alias("rule_id"), "file", F.col("line").alias("line_start")).join(said, ["rule_id", "file"]).withColumnRenamed("file", "file_path")
    return with_place(rows, "place").select((F.floor(F.col("place") / size) + 1).cast("int").alias("batch"), "place", F.col("rule_id").alias("model"), "said")


def prompts(batches: DataFrame) -> DataFrame:
    """batch, prompt: one text a batch, of a bounded number of models."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "model", "said"))), lambda x: F.concat(F.lit("## "), x["model"], F.lit("\n"), x["said"]))
    return batches.groupBy("batch").agg(F.array_join(lines, "\n\n").alias("prompt"))


def classified(answers: DataFrame, models: DataFrame, fields: DataFrame) -> DataFrame:
    """model, field, classification, reason, file, field_type: the recorded answers (``answer``: JSON) met with the code.

    Answers that are no JSON say nothing; unknown classes are NOT_PII; models and fields that the code does not have keep empty file and type.
    """
    said = answers.select(F.explode(F.from_json("answer", ANSWER)["models"]).alias("m")).select(F.col("m.model_name").alias("model"), F.explode("m.fields").alias("f")).filter("model <> ''")
    said = said.select("model", F.coalesce("f.field_name", F.lit("")).alias("field"), normalise_classification(F.coalesce("f.classification", F.lit("NOT_PII"))).alias("classification"), F.coalesce("f.reason", F.lit("")).alias("reason"))
    of_model = models.groupBy(F.col("name").alias("model")).agg(F.min("file").alias("file"))
    of_field = fields.groupBy("model", F.col("name").alias("field")).agg(F.min_by("field_type", F.struct("file", "line")).alias("field_type"))
    out = said.join(of_model, "model", "left").join(of_field, ["model", "field"], "left")
    return out.select("model", "field", "classification", "reason", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("field_type", F.lit("")).alias("field_type"))


def special_fields(answers: DataFrame) -> DataFrame:
    """kind (aadhaar, financial, health), field: what the batches name together."""
    a = answers.select(F.from_json("answer", ANSWER).alias("a"))
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"a.{k}_fields").alias("l")) for k in ("aadhaar", "financial", "health")])
    return a.select(F.inline(lists)).select("kind", F.explode("l").alias("field")).distinct()


def children_risk(answers: DataFrame) -> DataFrame:
    """One row: whether any batch sees a risk."""
    return answers.agg(F.coalesce(F.bool_or(F.from_json("answer", ANSWER)["children_data_risk"]), F.lit(False)).alias("children_data_risk"))


def special_unencrypted(special: DataFrame, fields: DataFrame) -> DataFrame:
    """The named fields ("Model.field" or "field") that the code keeps in the clear."""
    plain = fields.filter(~F.col("is_encrypted")).select(F.concat("model", F.lit("."), "name").alias("full"), F.col("name").alias("bare"))
    named = plain.select(F.explode(F.array("full", "bare")).alias("field")).distinct()
    return special.join(named, "field", "left_semi")


def pii_stats(pii: DataFrame) -> DataFrame:
    c = F.col("classification")
    return pii.agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "PII").alias("pii"), F.count_if(c == "SENSITIVE_PII").alias("sensitive"), F.count_if(c == "INDIRECT").alias("indirect"), F.count_if(~c.isin("PII", "SENSITIVE_PII", "INDIRECT")).alias("not_pii"), F.count_distinct(F.when(c.isin(*PERSONAL), F.col("model"))).alias("pii_models"))


def codebase_stats(models: DataFrame, fields: DataFrame, endpoints: DataFrame, libraries: DataFrame) -> DataFrame:
    m = models.agg(F.count(F.lit(1)).alias("models"), F.count_if("has_delete_method").alias("with_delete"), F.count_if("has_soft_delete").alias("with_soft_delete"))
    f = fields.agg(F.count(F.lit(1)).alias("fields"), F.count_if("is_encrypted").alias("encrypted_fields"))
    e = endpoints.agg(F.count(F.lit(1)).alias("endpoints"), F.count_if("requires_auth").alias("with_auth"))
    lib = libraries.agg(F.count(F.lit(1)).alias("libraries"))
    return m.join(f, F.lit(True)).join(e, F.lit(True)).join(lib, F.lit(True))  # one row each


def section(stats: DataFrame, name: str, title: str, status: Column, evidence_: Column, blockers: Column, remediation: Column, calls: int = 0) -> DataFrame:
    empty = F.array().cast("array<string>")
    blank = F.col("n_models") == 0
    return stats.select(
        F.lit(name).alias("section"), F.lit(title).alias("title"), F.when(blank, "COMPLIANT").otherwise(status).alias("status"), F.when(blank, F.array(F.lit("No personal data was found."))).otherwise(evidence_).alias("evidence"),
        F.when(blank, empty).otherwise(blockers).alias("blockers"), F.when(blank, empty).otherwise(remediation).alias("remediation"), F.when(blank, 0).otherwise(F.lit(calls)).cast("int").alias("llm_calls_made"),
    )


def _join(*one_row: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, F.lit(True)), one_row)


def _some(rows: DataFrame, column: Column | str, n: int, name: str) -> DataFrame:
    """One row: at most n distinct values, the smallest first; no task ever holds more."""
    value = F.col(column) if isinstance(column, str) else column
    top = rows.select(value.alias("v")).filter("v IS NOT NULL").distinct().orderBy("v").limit(n)
    return top.agg(F.array_sort(F.collect_list("v")).alias(name))


def _models(pii: DataFrame) -> DataFrame:
    return pii_models(pii).agg(F.count(F.lit(1)).alias("n_models"))


def encryption(code: dict[str, DataFrame], pii: DataFrame) -> DataFrame:
    last = code["fields"].groupBy("model", "name").agg(F.last("is_encrypted").alias("is_encrypted"))
    personal = pii.filter(F.col("classification").isin(*PERSONAL)).select("model", F.col("field").alias("name"))
    joined = personal.join(last, ["model", "name"], "left").withColumn("is_encrypted", F.coalesce("is_encrypted", F.lit(False)))
    name = F.concat("model", F.lit("."), "name")
    stats = joined.agg(F.count(F.lit(1)).alias("n_models"), F.count_if("is_encrypted").alias("yes"), F.count_if(~F.col("is_encrypted")).alias("no"))
    stats = _join(stats, _some(joined.filter(~F.col("is_encrypted")), name, 10, "plain"), _some(joined.filter("is_encrypted"), name, 10, "safe"))
    status = F.when(F.col("no") == 0, "COMPLIANT").when(F.col("yes") == 0, "NON_COMPLIANT").otherwise("PARTIAL")
    return section(stats, "§8(4)", "Encryption of personal data", status, F.transform("safe", lambda x: F.concat(F.lit("encrypted: "), x)), F.transform("plain", lambda x: F.concat(F.lit("not encrypted: "), x)), F.when(F.col("no") > 0, F.array(F.lit("Encrypt personal fields at rest."))).otherwise(F.array().cast("array<string>")))


def _lines(*parts: tuple[Column, Column | str]) -> Column:
    """An array of those texts whose condition holds."""
    return F.array_compact(F.array(*[F.when(test, F.lit(said) if isinstance(said, str) else said) for test, said in parts])).cast("array<string>")


def _each(column: str, before: str) -> Column:
    return F.transform(column, lambda x: F.concat(F.lit(before), x))


def _of_personal(rows: DataFrame, pii: DataFrame, column: str) -> DataFrame:
    return rows.join(pii_models(pii).select(F.col("model").alias("__model")), F.col(column) == F.col("__model"), "left_semi")


def retention(code: dict[str, DataFrame], pii: DataFrame) -> DataFrame:
    """Fields that end a record, policies and schedules in the code, commands of administration, soft deletes."""
    dated = code["fields"].filter(F.lower("name").isin(*RETENTION_FIELDS))
    fields = _of_personal(dated, pii, "model")
    found = stored(evidence(code["files"], {"policy": RETENTION_POLICY, "scheduler": SCHEDULERS, "command": MANAGEMENT}))
    found = found.withColumn("command", F.when(F.col("file_path").contains("management/commands/"), F.col("command")))
    seen = found.agg(F.count("policy").alias("policies"), F.count("scheduler").alias("schedulers"))
    soft = _of_personal(code["models"].filter("has_soft_delete"), pii, "name")
    full = F.concat("model", F.lit("."), "name")
    at = lambda column: F.concat("file_path", F.lit(":"), column)
    stats = _join(_models(pii), fields.agg(F.count(F.lit(1)).alias("fields")), seen, _some(fields, full, 10, "named"), _some(dated, full, 5, "elsewhere"), _some(found, at("policy"), 5, "said"), _some(found, at("scheduler"), 5, "scheduled"), _some(found.filter("command IS NOT NULL"), "file_path", 5, "commanded"), _some(soft, "name", 10, "soft"))
    none, unpurged = F.col("fields") == 0, (F.col("schedulers") == 0) & (F.col("policies") == 0)
    status = F.when((F.col("fields") > 0) | (F.col("policies") > 0), "PARTIAL").otherwise("NON_COMPLIANT")
    said = F.concat(_each("named", "ends: "), F.when(none, _each("elsewhere", "ends elsewhere: ")).otherwise(F.array().cast("array<string>")), _each("said", "policy: "), _each("scheduled", "schedule: "), _each("commanded", "command: "), _each("soft", "deleted softly: "))
    blockers = _lines((none, "No personal model has a field that ends its records."), (unpurged, "Nothing purges old records."))
    return section(stats, "§8(5)", "Data retention", status, said, blockers, _lines((none, "Give personal records an end date."), (F.col("schedulers") == 0, "Purge them on a schedule.")))


def breach(code: dict[str, DataFrame], pii: DataFrame) -> DataFrame:
    """Alerting libraries and settings, words of a breach in the code, models of an audit log, ways to send messages."""
    libraries = stored(code["libraries"].select("module", "file", "category"))
    alerts = libraries.filter(F.lower(F.substring_index("module", ".", 1)).isin(*ALERTING)).select(F.concat("module", F.lit(" in "), "file").alias("alert"))
    settings = code["files"].filter(F.col("file_path").rlike(SETTINGS_PATH) & F.col("content").rlike("(?i)SENTRY_DSN|sentry_sdk[.]init|PAGERDUTY|OPSGENIE|DATADOG"))
    alerts = stored(alerts.unionByName(settings.select(F.concat(F.lit("configured in "), "file_path").alias("alert"))))
    found = stored(evidence(code["files"], {"breach": BREACH, "mail": NOTIFICATION}))
    audits = code["models"].filter(F.col("name").rlike("(?i)" + "|".join(AUDIT_MODELS)))
    logging = libraries.filter(F.col("category") == "logging")
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    stats = _join(
        _models(pii), count(alerts, "alerting"), found.agg(F.count("breach").alias("breach"), F.count("mail").alias("mails")), count(audits, "audits"), count(logging, "logging"),
        _some(alerts, "alert", 5, "alerts"), _some(found, F.concat("file_path", F.lit(":"), "breach"), 5, "said"), _some(audits, "name", 5, "logs"),
    )
    watched, named = F.col("alerting") > 0, F.col("breach") > 0
    status = F.when(watched | (F.col("audits") > 0), "PARTIAL").otherwise("NON_COMPLIANT")
    more = _lines((F.col("logging") > 0, F.concat(F.col("logging").cast("string"), F.lit(" imports of logging"))), (F.col("mails") > 0, "Messages can be sent."))
    blockers = _lines((~named, "Nothing in the code handles a breach."), (~watched, "No alerting: a breach may go unseen."))
    todo = _lines((~watched, "Connect an alerting service."), (~named, "Tell the authority and the people concerned."), (F.col("audits") == 0, "Keep an audit log of what is read."))
    return section(stats, "§8(6)", "Breach notification", status, F.concat(_each("alerts", "alerting: "), _each("logs", "audit log: "), _each("said", "breach: "), more), blockers, todo)


def children(code: dict[str, DataFrame], pii: DataFrame, risk: bool = False) -> DataFrame:
    """Fields of age, models of children, checks of age and parents' consent in the code. ``risk``: a classification saw one."""
    fields = _of_personal(code["fields"].filter(F.lower("name").isin(*AGE_FIELDS)), pii, "model")
    child = code["models"].filter(F.lower("name").rlike("|".join(CHILD_MODELS)))
    # a file counts for parental consent only where no earlier family of words is found in it
    seen = stored(evidence(code["files"], {"first": CHILD, "gate": AGE_GATE}))
    parental = F.col("first").rlike("(?i): .*(?:parental|guardian)")
    at = lambda column: F.concat("file_path", F.lit(":"), column)
    stats = _join(
        _models(pii), fields.agg(F.count(F.lit(1)).alias("ages")), child.agg(F.count(F.lit(1)).alias("child_models")), seen.agg(F.count("gate").alias("gates"), F.count_if(parental).alias("parental")),
        _some(fields, F.concat("model", F.lit("."), "name"), 10, "named"), _some(child, "name", 10, "kids"), _some(seen, at("gate"), 5, "gated"), _some(seen.filter(parental), "file_path", 5, "asked"), _some(seen.filter(~parental), at("first"), 5, "said"),
    )
    collects = (F.col("ages") > 0) | (F.col("child_models") > 0) | F.lit(risk)
    unchecked, unasked = (F.col("ages") > 0) & (F.col("gates") == 0), collects & (F.col("parental") == 0)
    status = F.when(~collects, "COMPLIANT").when((F.col("gates") > 0) & (F.col("parental") > 0), "PARTIAL").when(unchecked, "NON_COMPLIANT").otherwise("PARTIAL")
    said = F.concat(_each("named", "age: "), _each("kids", "model: "), _each("gated", "check: "), _each("asked", "parents asked: "), _each("said", "mention: "), _lines((F.lit(risk), "A classification sees a risk to children.")))
    blockers = _lines((unchecked, "Ages are kept but never checked."), (unasked, "No parent's consent is asked for."))
    return section(stats, "§9", "Data of children", status, said, blockers, _lines((unchecked, "Check ages where people register."), (unasked, "Ask for a parent's consent."), (collects, "Do not track or target children.")))


def localisation(code: dict[str, DataFrame], pii: DataFrame) -> DataFrame:
    files = code["files"].filter(F.col("file_path").rlike(r"(?i)(?:\.py|\.ya?ml|\.toml|\.ini|\.env|\.conf|(?:^|/)Dockerfile)$"))
    line = lambda p: F.exists(F.split("content", "\n"), lambda x: x.rlike("(?i)" + "|".join(REGIONS)) & x.rlike("(?i)" + p))
    c = F.col("content")
    any_of = lambda ps: c.rlike("|".join(f"(?i:{p})" for p in ps))
    flags = files.agg(
        F.count_if(any_of(REGIONS)).alias("regions"), F.count_if(any_of(STORAGE)).alias("storage"), F.count_if(any_of(DATABASES)).alias("databases"), F.count_if(line("|".join(INDIAN_REGIONS))).alias("home"), F.count_if(line(FOREIGN_REGIONS)).alias("foreign"),
    )
    calls = code["files"].filter(F.col("file_path").endswith(".py") & any_of(EXTERNAL_CALLS))
    stats = _join(_models(pii), flags, _some(files.filter(any_of(REGIONS)), "file_path", 15, "said"), _some(calls, "file_path", 5, "calls"))
    status = F.when((F.col("regions") == 0) & (F.col("storage") == 0) & (F.col("databases") == 0), "UNKNOWN").when((F.col("home") > 0) & (F.col("foreign") == 0), "COMPLIANT").otherwise("PARTIAL")
    return section(stats, "§11", "Data localisation", status, F.concat(F.transform("said", lambda x: F.concat(F.lit("region: "), x)), F.transform("calls", lambda x: F.concat(F.lit("calls another service: "), x))), F.when(F.col("foreign") > 0, F.array(F.lit("A region abroad is configured."))).otherwise(F.array().cast("array<string>")), F.array(F.lit("State where personal data is stored.")))


def named_in(rows: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows joined with every name that stands somewhere in their ``column``, whatever the case.

    A row asks for each of its runs of letters that is as long as some name, and a name is met by its whole self, so that names which have pieces in
    common are never compared. The lengths of names are one small row; neither side is broadcast.
    """
    low, key = F.lower(F.col(column)), F.lower(F.col(name))
    filed = names.withColumn("__key", key).filter(F.col("__key") != "")
    lengths = filed.agg(F.collect_set(F.length("__key")).alias("__lengths"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("__low") - n + 1), lambda i: F.substring(F.col("__low"), i, n))
    fit = F.filter("__lengths", lambda n: n <= F.length("__low"))
    asked = rows.withColumn("__low", low).join(F.broadcast(lengths), F.lit(True)).withColumn("__key", F.explode(F.array_distinct(F.flatten(F.transform(fit, runs)))))
    return asked.join(filed, "__key").drop("__low", "__key", "__lengths")


def _related(endpoints: DataFrame) -> DataFrame:
    """Endpoints with ``eid`` and ``related``: all models that they read, write or delete."""
    empty = F.array().cast("array<string>")
    both = F.array_union(F.array_union(F.coalesce("models_deleted", empty), F.coalesce("models_written", empty)), F.coalesce("models_read", empty))
    return endpoints.withColumns({"eid": F.xxhash64("path", "handler", "file", "line", F.array_join("http_methods", ",")), "related": both})


def touching(endpoints: DataFrame, personal: DataFrame, fallback: bool = False) -> DataFrame:
    """eid, path, file, requires_auth, model, how: endpoints with the personal models that they touch, by name in what they read, write or delete, or
    by the model's name inside the view's name. ``fallback``: by the view only where no name was found; else both give rows."""
    e = _related(endpoints)
    kept = ("eid", "path", "file", "requires_auth")
    exact = e.select(*kept, F.explode("related").alias("model")).join(personal, "model", "left_semi").select(*kept, "model", F.lit("name").alias("how"))
    rest = e.filter("viewset_class IS NOT NULL")
    rest = rest.join(exact.select("eid").distinct(), "eid", "left_anti") if fallback else rest
    inside = named_in(rest.select(*kept, "viewset_class"), "viewset_class", personal, "model").select(*kept, "model", F.lit("view").alias("how"))
    return exact.unionByName(inside)


def _verdict(verdicts: DataFrame | None, name: str, stats: DataFrame) -> DataFrame:
    if verdicts is None:
        return stats.withColumn("verdict", F.lit("UNKNOWN"))
    v = verdicts.filter(F.col("section") == name).agg(F.max("verdict").alias("v"))
    return _join(stats, v).withColumn("verdict", F.when(F.col("v").isin("COMPLIANT", "PARTIAL", "NON_COMPLIANT"), F.col("v")).otherwise("UNKNOWN"))


def erasure(code: dict[str, DataFrame], pii: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """DELETE endpoints of personal models, models without one, what blocks or follows a deletion, and how models are deleted."""
    personal = pii_models(pii).select("model")
    deletes = stored(touching(code["endpoints"].filter(F.array_contains("http_methods", "DELETE")), personal))
    missing = personal.join(deletes.select("model").distinct(), "model", "left_anti")
    paths = _of_personal(code["delete_paths"], pii, "target_model")
    models = _of_personal(code["models"], pii, "name")
    stats = _join(
        _models(pii), deletes.agg(F.count(F.lit(1)).alias("deletes"), F.count_if(~F.coalesce("requires_auth", F.lit(False))).alias("open")), paths.agg(F.count_if(F.col("on_delete") == "CASCADE").alias("cascades")),
        models.agg(F.count_if("has_soft_delete").alias("soft"), F.count_if("has_delete_method").alias("hard")), _some(missing, "model", 10, "without"), _some(deletes, "path", 10, "paths"), _some(models.filter("has_soft_delete"), "name", 10, "softly"),
        _some(paths.filter("is_blocker"), F.concat("source_model", F.lit("."), "field_name", F.lit(" keeps "), "target_model"), 10, "kept"),
    )
    stats = _verdict(verdicts, "§7(3)", stats)
    number = lambda c, said: F.concat(F.col(c).cast("string"), F.lit(said))
    counts = F.array(number("deletes", " ways to delete personal models"), number("open", " of them open to all"), number("cascades", " cascading paths"), number("hard", " models with a method of their own"))
    said = F.concat(counts, _each("paths", "DELETE "), _each("softly", "deleted softly: "), _each("without", "no DELETE for "))
    todo = _lines((F.size("without") > 0, "Offer deletion for every personal model."), (F.size("kept") > 0, "Delete or anonymise what keeps a record before the record."), (F.col("soft") > 0, "Purge what is deleted softly."))
    return section(stats, "§7(3)", "Erasure", F.col("verdict"), said, F.col("kept"), todo, 1)


def consent(code: dict[str, DataFrame], pii: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Models of consent, endpoints that take personal data in, and mentions of consent in the files of these endpoints and in settings."""
    personal = pii_models(pii).select("model")
    posts = code["endpoints"].filter(F.arrays_overlap("http_methods", F.array(F.lit("POST"), F.lit("ANY"))))
    collecting = stored(touching(posts, personal, fallback=True))
    models = code["models"].filter(F.lower("name").contains("consent"))
    handlers = collecting.select(F.col("file").alias("file_path")).distinct()
    mentions = reduce(lambda a, b: a + b, [F.regexp_count("content", F.lit(f"(?i){p}")) for p in CONSENT])
    middleware = F.col("content").rlike("(?i)consent_?middleware")
    said = code["files"].join(handlers, "file_path", "left_semi").select("file_path", mentions.alias("n"), middleware.alias("middleware"))
    settings = code["files"].filter(F.col("file_path").rlike(SETTINGS_PATH) & F.col("content").rlike("(?i)ConsentMiddleware|consent_required")).select("file_path", F.lit(1).alias("n"), F.lit(True).alias("middleware"))
    words = stored(said.unionByName(settings)).filter("n > 0")
    stats = _join(
        _models(pii), models.agg(F.count(F.lit(1)).alias("models")), collecting.agg(F.count_distinct("eid").alias("posts")), words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.bool_or("middleware"), F.lit(False)).alias("middleware")),
        _some(models, "name", 10, "names"), _some(collecting, F.concat("path", F.lit(" takes "), "model"), 5, "paths"), _some(words, F.concat("file_path", F.lit(": "), F.col("n").cast("string")), 10, "mentions"),
    )
    stats = _verdict(verdicts, "§4", stats)
    number = lambda c, said: F.concat(F.col(c).cast("string"), F.lit(said))
    evidence_ = F.concat(F.array(number("models", " models of consent"), number("posts", " endpoints take personal data"), number("words", " mentions of consent")), _each("names", "model: "), _each("paths", ""), _each("mentions", "mentions in "), _lines((F.col("middleware"), "Consent is asked for on the way in.")))
    blockers = _lines(((F.col("posts") > 0) & (F.col("words") == 0), "Personal data is taken in where consent is never mentioned."))
    return section(stats, "§4", "Consent", F.col("verdict"), evidence_, blockers, _lines((F.col("models") == 0, "Keep a record of consent."), (F.col("words") == 0, "Ask for consent before collecting.")), 1)


def minimisation(code: dict[str, DataFrame], pii: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    counts = _some(pii_models(pii), F.concat("model", F.lit(": "), F.col("n_fields").cast("string")), 10, "counts")
    return section(_verdict(verdicts, "§5", _join(_models(pii), counts)), "§5", "Minimisation", F.col("verdict"), F.col("counts"), F.array().cast("array<string>"), F.array(F.lit("Keep only the fields that are needed.")), 1)


ALL: tuple[Section, ...] = (consent, minimisation, erasure, encryption, retention, breach, children, localisation)


def report(code: dict[str, DataFrame], pii: DataFrame, sections: tuple[Section, ...] = ALL) -> DataFrame:
    """All sections, sorted by their names as strings. A section that cannot be planned is UNKNOWN with its error."""
    rows = []
    spark: SparkSession = pii.sparkSession
    for s in sections:
        try:
            rows.append(s(code, pii))
        except Exception as e:  # noqa: BLE001
            from ..schemas import SECTION

            rows.append(spark.createDataFrame([(s.__name__, s.__name__, "UNKNOWN", [], [f"Analyzer error: {e}"[:300]], [], 0)], SECTION))
    return reduce(DataFrame.unionByName, rows).orderBy("section")


def report_summary(sections: DataFrame) -> DataFrame:
    s = F.col("status")
    out = sections.agg(*[F.count_if(s == x).alias(x.lower()) for x in ("COMPLIANT", "PARTIAL", "NON_COMPLIANT", "UNKNOWN")], F.sum("llm_calls_made").alias("llm_calls"))
    return out.withColumn("headline", F.when((F.col("non_compliant") == 0) & (F.col("partial") == 0), "compliant").when(F.col("non_compliant") == 0, "partial").otherwise("non-compliant"))


def report_markdown(sections: DataFrame) -> str:
    lines = ["## Privacy report"]
    for r in sections.collect():
        lines += [f"### {r['section']} {r['title']}: {r['status']}", *[f"- {x}" for x in r["evidence"][:5 if r["status"] == "COMPLIANT" else 10]], *[f"- blocked: {x}" for x in r["blockers"][:10]], *[f"- to do: {x}" for x in r["remediation"][:5]]]
    return "\n".join(lines)


#: How a status is marked in the text report.
MARKS = {"COMPLIANT": "[PASS]", "PARTIAL": "[WARN]", "NON_COMPLIANT": "[FAIL]", "UNKNOWN": "[????]"}
WIDTH = 72


def report_text(sections: DataFrame, root: str, sha: str | None = None, elapsed: float = 0.0) -> str:
    """The report for a terminal; a section is one row, so there are as many rows as sections."""
    rows, rule = sections.orderBy("section").collect(), "=" * WIDTH
    calls = sum(r["llm_calls_made"] for r in rows)
    out = [rule, "  COMPLIANCE REPORT", rule, f"  Repository: {root}", *([f"  Commit:     {sha[:12]}"] if sha else []), f"  Sections:   {len(rows)}  |  LLM calls: {calls}  |  Time: {elapsed:.1f}s", rule, ""]
    for r in rows:
        out += [f"{MARKS.get(r['status'], '?')} {r['section'] + ' ' + r['title']:<50} {r['status']}", "-" * WIDTH]
        for n, (name, lines) in enumerate((("Evidence", r["evidence"]), ("Blockers", r["blockers"]), ("Remediation", r["remediation"]))):
            if lines:
                out += [*([""] if n else []), f"  {name}:", *(f"    - {x}" for x in lines)]
        out += ["", ""]
    out += [rule, "  SUMMARY", rule]
    for status in MARKS:
        if n := sum(r["status"] == status for r in rows):
            out.append(f"  {MARKS[status]} {status}: {n}")
    return "\n".join([*out, f"  Total LLM calls: {calls}", f"  Total time: {elapsed:.1f}s", rule])


def save_classification(pii: DataFrame, path: str, root: str, sha: str | None) -> None:
    """Keep a classification for a repository at a commit; without a commit nothing is kept."""
    if sha:
        pii.withColumns({"key": cache_key(F.lit(root), F.lit(sha))}).write.mode("append").partitionBy("key").parquet(path)


def load_classification(spark: SparkSession, path: str, root: str, sha: str | None) -> DataFrame | None:
    """What was kept for this commit, read from its own folder only; None when there is nothing."""
    if not sha or not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return None
    rows = spark.read.parquet(path).filter(F.col("key") == cache_key(F.lit(root), F.lit(sha))).drop("key").distinct()
    return rows if rows.limit(1).count() else None
