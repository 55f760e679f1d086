"""Path functions: language, test and migration files, confidence, ignore globs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffix to language.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rb": "ruby", ".php": "php",
    ".rs": "rust", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".env": "env", ".toml": "toml", ".ini": "ini", ".conf": "conf",
}
#: What a test path looks like, each searched without case in a path with forward slashes.
TEST_PATHS = (
    r"(?:^|/)tests?/", r"(?:^|/)__tests__/", r"(?:^|/)spec/", r"(?:^|/)test_[^/]+$", r"(?:^|/)[^/]+_test\.(?:py|go|rs|js|ts)$", r"(?:^|/)conftest\.py$", r"\.(?:test|spec)\.(?:js|ts|jsx|tsx)$",
    r"(?:^|/)fixtures?/", r"(?:^|/)mocks?/", r"(?:^|/)testing/", r"(?:^|/)(?:load_|seed_|create_)?(?:fixtures?|test_data|fake_data|factory|factories)\.", r"(?:^|/)(?:conftest|factories|test_helpers|test_utils)\.",
)
MIGRATION_PATHS = (r"(?:^|/)migrations?/", r"(?:^|/)alembic/")
PATTERN_CONFIDENCE, AST_CONFIDENCE, TEST_CONFIDENCE, MIGRATION_CONFIDENCE = 0.85, 0.9, 0.3, 0.4
#: Globs that are ignored unless configured otherwise.
IGNORED = (
    "**/__pycache__/**", "**/*.pyc", "**/migrations/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/.nuxt/**", "**/*.min.js", "**/*.min.css", "**/*.bundle.js", "**/vendor/**", "**/third_party/**",
    "**/generated/**", "**/.gen/**", "**/package-lock.json", "**/yarn.lock", "**/go.sum", "**/Pipfile.lock", "**/poetry.lock", "**/.venv/**", "**/venv/**", "**/.tox/**", "**/.idea/**", "**/.vscode/**",
)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def detect_language(path: Column) -> Column:
    """Null where the suffix is unknown. A dot file without a suffix counts by its whole name."""
    suffix = F.lower(F.regexp_extract(slashed(path), r"(?:^|/)[^/]*[^/.][^/]*(\.[^./]+)$|(?:^|/)(\.[^./]+)$", 1))
    dot = F.lower(F.regexp_extract(slashed(path), r"(?:^|/)(\.[^./]+)$", 1))
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LANGUAGES.items()))
    return F.try_element_at(table, F.when(suffix != "", suffix).otherwise(dot))


def is_test_file(path: Column) -> Column:
    return slashed(path).rlike(any_of(TEST_PATHS))


def is_migration_file(path: Column) -> Column:
    return slashed(path).rlike(any_of(MIGRATION_PATHS))


def confidence(path: Column, base: float = PATTERN_CONFIDENCE) -> Column:
    return F.when(is_test_file(path), F.lit(TEST_CONFIDENCE)).when(is_migration_file(path), F.lit(MIGRATION_CONFIDENCE)).otherwise(F.lit(base))


def glob_regex(glob: str) -> str:
    """A shell glob as a regex: ``*`` crosses slashes, as file-name matching does."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) >= 0:
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else "\\" + body if body[:1] == "^" else body) + "]"
            i = end + 1
        else:
            out += "\\" + c if c in r".^$+{}()|\[]" else c
    return out


def is_ignored(path: Column, globs: tuple[str, ...] = IGNORED) -> Column:
    return path.rlike("(?s)^(?:" + "|".join(map(glob_regex, globs)) + ")$") if globs else F.lit(False)
