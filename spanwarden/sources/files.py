"""Files to rows: directory trees, single files, the corpus tables, baselines, changed files of a pull request."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES, detect_language


def decode(content: Column, translate: bool = True) -> Column:
    """UTF-8 with replacement of what is malformed; ``translate`` turns all line ends into line feeds."""
    said = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(said, "\r\n?", "\n") if translate else said


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tuple(LANGUAGES), skip_dirs: tuple[str, ...] = ("__pycache__",), hidden: bool = False) -> DataFrame:
    """file_path (relative), content of all files below ``root``. Folders and names that start with a dot are left out."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    clean = F.regexp_replace(F.col("path"), "^file:/+", "/")
    inside = F.substring_index(clean, base.removeprefix("file://") + "/", -1)
    rows = raw.select(inside.alias("file_path"), "content")
    if not hidden:
        rows = rows.filter(~F.col("file_path").rlike(r"(?:^|/)\."))
    for d in skip_dirs:
        rows = rows.filter(~F.concat(F.lit("/"), F.col("file_path")).contains(f"/{d}/"))
    if suffixes:
        rows = rows.filter(F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    return rows.select("file_path", decode(F.col("content")).alias("content"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as one row; its reported path is "."."""
    return spark.read.format("binaryFile").load(path).select(F.lit(".").alias("file_path"), decode(F.col("content")).alias("content"))


#: Folders and suffixes that give documents a path; see ``documents_as_files``.
_DIRS = ("src", "tests", "app/migrations", "vendor/lib", "pkg/fixtures")
_SUFFIXES = (".py", ".js", ".ts", ".java", ".yml", ".md")


def _pick(values: tuple[str, ...]) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(F.col("doc_id") % len(values) == i, v) if out is None else out.when(F.col("doc_id") % len(values) == i, v)
    return out


def documents_as_files(documents: DataFrame) -> DataFrame:
    """doc_id, file_path, content: every document as a file of a made-up tree."""
    path = F.concat(_pick(_DIRS), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), _pick(_SUFFIXES))
    return documents.select("doc_id", path.alias("file_path"), F.col("text").alias("content"))


#: What ``documents_as_code`` picks from, by the document's number.
CODE_LIBRARIES = ("cryptography.fernet", "hashlib", "jwt.api", "jwtx", "os.path", "sentry_sdk", "Django.contrib.auth", "boto3")
CODE_FIELDS = ("CharField", "EncryptedCharField", "EmailField", "JSONField", "OddField")
CODE_ACTIONS = ("CASCADE", "PROTECT", "SET_NULL", "DO_NOTHING", "RESTRICT", "SET_DEFAULT")
CODE_DEPENDENTS = ("destroy", "delete_all", "nullify", "restrict_with_error", "touch")
CODE_COLUMNS = ("STRING", "JSONB", "GEOMETRY")
CODE_JAVA = ("String", "BigDecimal", "Address")
CODE_PRISMA = ("Json", "Decimal", "Blob")


def documents_as_code(documents: DataFrame) -> DataFrame:
    """doc_id, file_path, content: for every document a source file (Python, Ruby, JavaScript, Java, Prisma or a list of requirements)
    whose names and choices follow from its number and length."""
    d, turn = F.col("doc_id"), F.floor(F.col("doc_id") / 6)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn % len(values)).cast("int") + 1)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    null = F.when(turn % 2 == 0, "True").otherwise("False")
    contents = (
        join("import ", pick(CODE_LIBRARIES), "\nfrom django.db import models\n\n\nclass M", d, "(models.Model):\n    name = models.", pick(CODE_FIELDS), "(max_length=", F.coalesce("n_chars", F.lit(0)) % 200 + 1, ", null=", null, ")\n    owner = models.ForeignKey('M", d + 6, "', on_delete=models.", pick(CODE_ACTIONS), ")\n\n    def delete(self):\n        return None\n"),
        join("class M", d, " < ApplicationRecord\n  has_many :m", d, "_items, dependent: :", pick(CODE_DEPENDENTS), "\nend\n"),
        join("const x = require('", F.when(turn % 2 == 0, "bcrypt").otherwise("cors"), "')\napp.get('/m", d, "/', list", d, ")\nM", d, ".init({\n  email: DataTypes.", pick(CODE_COLUMNS), ",\n}, { sequelize })\n"),
        join("import org.slf4j.Logger;\n@Entity\npublic class M", d, " {\n  private ", pick(CODE_JAVA), " code;\n}\n"),
        join("model M", d, " {\n  id Int\n  note ", pick(CODE_PRISMA), "?\n}\n"),
        join("flask>=2.", d % 10, "\nrequests==1.", d % 7, ".0\n"),
    )
    names = (join("app/m", d, ".py"), join("app/m", d, ".rb"), join("app/m", d, ".js"), join("app/M", d, ".java"), join("m", d, ".prisma"), join("svc", d, "/requirements.txt"))
    of = lambda values: F.element_at(F.array(*values), (d % 6).cast("int") + 1)
    return documents.select("doc_id", of(names).alias("file_path"), of(contents).alias("content"))


def pages_as_files(pages: DataFrame) -> DataFrame:
    return pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".conf")).alias("file_path"), F.col("html").alias("content"))


def conversations_as_files(conversations: DataFrame) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.groupBy("conv_id").agg(turns.alias("t")).select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file_path"), F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("content"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Known fingerprints; a missing or broken file knows none."""
    from ..schemas import BASELINE

    empty = spark.createDataFrame([], "fingerprint string")
    if not path.startswith(("hdfs:", "s3", "viewfs:")) and not Path(path.removeprefix("file://")).exists():
        return empty
    return spark.read.schema(BASELINE).json(path, multiLine=True).select(F.explode("violations").alias("v")).select("v.fingerprint").filter("fingerprint IS NOT NULL")


def changed_files(listing: DataFrame) -> DataFrame:
    """``listing``: filename, status, content (base64). Removed and unchanged files go, and files of no known language."""
    kept = listing.filter(F.col("status").isin("added", "modified", "renamed", "changed"))
    return kept.select(F.col("filename").alias("file_path"), decode(F.try_to_binary(F.col("content"), F.lit("base64")), translate=False).alias("content")).filter(detect_language(F.col("file_path")).isNotNull())


def _commented(text: Column, mark: str) -> Column:
    """A text as lines of comment, so that a source file can hold it."""
    return F.concat(F.lit(f"{mark} "), F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n\x00\x0b\x0c\x1c\x1d\x1e\x85  ]+", f"\n{mark} "))


#: What ``documents_as_programs`` picks from, by the document's number.
PROGRAM_NAMES = ("transfer_funds", "helper", "repay_loan", "load_page", "debit_account", "parse", "credit_note")


def documents_as_programs(documents: DataFrame) -> DataFrame:
    """doc_id, file_path, content: every document as a program (three of four in Python, the others in JavaScript) that has its text as comment.

    A function moves money or not, with or without an audit record; in Python another one sends a browser to an address from its
    request, through up to five variables, some of them cleaned or replaced on the way.
    """
    d = F.col("doc_id")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    when = lambda test, yes, no="": F.when(test, F.lit(yes)).otherwise(F.lit(no))
    name = F.element_at(F.array(*map(F.lit, PROGRAM_NAMES)), (d % len(PROGRAM_NAMES)).cast("int") + 1)
    steps = (d % 6).cast("int")
    chain = F.array_join(F.transform(F.sequence(F.lit(0), steps), lambda i: F.when(i == 0, F.lit("    v0 = request.args.get('u')\n")).otherwise(join("    v", i, " = v", i - 1, " + '/'\n"))), "")
    python = join(
        _commented(F.col("text"), "#"), "\nimport pickle\nfrom flask import redirect, request\n\n\nclass Desk", d, ":\n    def ", name, "(self, amount):\n", when(d % 3 == 0, '        """Moves it."""\n'),
        when(d % 4 == 0, "        audit_log(amount)\n", "        note = '} def audi'\n"), "        return pickle.", when(d % 2 == 0, "loads", "dumps"), "(amount)\n\n\ndef go(request):\n", chain,
        F.when(d % 5 == 0, join("    v", steps, " = quote(v", steps, ")\n")).otherwise(""), F.when(d % 7 == 0, join("    v", steps, " = '/home'\n")).otherwise(""), "    return redirect(v", steps, ")", when(d % 11 == 0, "  # scan:disable"), "\n",
    )
    javascript = join(
        _commented(F.col("text"), "//"), "\nconst shown = `{ ${ '}' + \"`\" } function gone() {`;\nfunction ", name, "(amount) {\n", when(d % 8 == 3, "  auditLog(amount);\n", '  const note = "} // audi";\n'),
        "  return /[{]/.test(amount) ? db.query(amount) : null;\n}\n",
    )
    is_js = d % 4 == 3
    path = F.when(is_js, join("web/desk", d, ".js")).otherwise(join("svc/desk", d, ".py"))
    return documents.select("doc_id", path.alias("file_path"), F.when(is_js, javascript).otherwise(python).alias("content"))


#: Versions that ``documents_as_manifests`` declares, from the least to the greatest; those of one row are equal. The last have none.
MANIFEST_VERSIONS = (("0.9.9",), ("1.0.dev3",), ("1.0a1",), ("1.0.0-beta.2", "1.0b2"), ("1.0rc1",), ("1", "1.0", "1.0.0"), ("1.0.post1",), ("1.0.1",), ("1.2.0",), ("1.10",), ("2.0.0-rc.1",), ("2.0+local.7", "v2"), ("1!0.1",), ("",))


def documents_as_manifests(documents: DataFrame) -> DataFrame:
    """doc_id, file_path, content: every document as a list of required packages, in Python's or in JavaScript's form."""
    d = F.col("doc_id")
    flat = [v for same in MANIFEST_VERSIONS for v in same]
    pick = lambda k: F.element_at(F.array(*map(F.lit, flat)), (k % len(flat)).cast("int") + 1)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pin = lambda v, mark: F.when(v == "", v).otherwise(F.concat(F.lit(mark), v))
    python = join("# made\nFlask", pin(pick(d), "=="), "\nold_Lib[extra]", pin(pick(d + 5), ">="), "  # scan:disable=old-lib\nother-lib", pin(pick(d + 9), "~="), "\n")
    javascript = join('{\n  "name": "old-lib",\n  "dependencies": {\n    "flask": "^', pick(d), '",\n    "lodash": "', pick(d + 5), '"\n  },\n  "devDependencies": {"left-pad": "~', pick(d + 9), '"}\n}\n')
    is_js = d % 3 == 2
    path = F.concat(F.lit("svc"), d.cast("string"), F.when(is_js, "/package.json").otherwise("/requirements.txt"))
    return documents.select("doc_id", path.alias("file_path"), F.when(is_js, javascript).otherwise(python).alias("content"))


def documents_as_braces(documents: DataFrame) -> DataFrame:
    """doc_id, file_path, content: every document as a model in JavaScript with the text in a comment inside it, and brackets in strings."""
    d = F.col("doc_id")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("*/"), F.lit("* /"))
    content = join("M", d, ".init({\n  a: DataTypes.STRING, // a } here\n  b: { type: DataTypes.", F.when(d % 2 == 0, "TEXT").otherwise("JSONB"), ", comment: '}' },\n  /* ", said, " } */\n  c: DataTypes.", F.when(d % 3 == 0, "DATE").otherwise("UUID"), ", d: `}${ {x: '}'} }`,\n  e: DataTypes.ENUM,\n}, { sequelize })\nlater: DataTypes.STRING\n")
    return documents.select("doc_id", F.concat(F.lit("models/m"), d.cast("string"), F.lit(".js")).alias("file_path"), content.alias("content"))
