"""Content rules over file texts.

A rule set is a literal table of a few dozen patterns. It is compiled into one expression per
file, so every pattern is a constant (compiled once per task) and no join is involved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.paths import base_name
from scanlake.functions.rows import each, each_struct
from scanlake.functions.text import find, lines, redact_env, sensitive_line


@dataclass(frozen=True)
class Rule:
    """Fires when ``present`` is found and ``absent`` is not; patterns see the text line by line."""

    severity: str
    message: str
    present: str | None = None
    absent: str | None = None
    first_line: bool = False


# The rule tables.
DOCKERFILE_RULES = (
    Rule("WARN", "Uses ':latest' tag", present=r"(?m)^FROM.*:latest"),
    Rule("WARN", "No USER instruction", absent="USER"),
    Rule("INFO", "Uses ADD", present="ADD "),
    Rule("INFO", "No HEALTHCHECK instruction", absent="HEALTHCHECK"),
)
SHELL_RULES = (
    Rule("WARN", "Missing shebang line", absent="^#!", first_line=True),
    Rule("WARN", "Uses eval", present="eval "),
)
MANIFEST_RULES = (
    Rule("CRITICAL", "Running in privileged mode", present="privileged: true"),
    Rule("HIGH", "Running as root user", present="runAsRoot|runAsUser: 0"),
    Rule("MEDIUM", "No resource limits defined", absent="resources:"),
    Rule("LOW", "readOnlyRootFilesystem not set", absent="readOnlyRootFilesystem"),
    Rule("HIGH", "Host namespace sharing enabled", present="hostNetwork: true|hostPID: true|hostIPC: true"),
    Rule("MEDIUM", "No securityContext defined", absent="securityContext:"),
    Rule("WARN", "Possible credential in non-Secret resource", present="(?i)(password|secret).*:", absent="kind: Secret"),
)
COMPOSE_RULES = (
    Rule("CRITICAL", "Privileged containers detected", present="privileged:"),
    Rule("HIGH", "Host network mode used", present="network_mode.*host"),
    Rule("WARN", "Hardcoded credentials detected in compose file", present="(?i)(password|secret).*:"),
    Rule("INFO", "No read-only filesystem configuration", absent="read_only:"),
    Rule("INFO", "No memory limits set", absent="mem_limit|memory:"),
    Rule("INFO", "No healthcheck defined", absent="healthcheck:"),
)
# Words of the credential scan and the files it looks at.
CREDENTIAL_WORDS = (
    "password", "secret", "token", "api_key", "private_key", "passwd", "credential", "auth_token",
    "access_key", "secret_key",
)
CREDENTIAL_FILES = r"\.(py|ts|tsx|js|yml|yaml|env|json|sh|sql|md)$"
ADDRESS_FILES = r"\.(py|ts|tsx|yaml|yml)$"
EXCLUDED_WORDS = "node_modules|.git/|keycloak-24|java17"
ADDRESS = r"([0-9]{1,3}\.){3}[0-9]{1,3}"
ROUTE = r"@router\.(get|post|put|delete|patch)"
LICENSE_FILES = r"(?i)^(LICENSE|LICENCE|COPYING)"
# Make targets, in the order they are looked for.
MAKE_TARGETS = (
    "docker-build", "build-image", "scan", "image", "docker", "container", "push", "build", "all", "test", "lint",
)
BUILD_TARGETS = ("build", "all")
DOCKER_TARGETS = ("docker-build", "build-image", "image", "docker", "container")
# Console phases, first match wins.
PHASE_RULES = (
    ("checking out|clone|git", "Checking out source code"),
    ("unit test|pytest|jest|go test|mvn test|dotnet test", "Running unit tests"),
    ("NO TESTS FOLDER DETECTED", "No test folder detected"),
    ("lint|eslint|flake8|checkstyle|golangci", "Running lint & code quality"),
    ("cyclonedx|sbom", "Generating SBOM"),
    ("sonarqube|sonar-scanner", "Running SonarQube analysis"),
    ("trivy|vulnerability scan", "Running vulnerability scan (Trivy)"),
    ("grype|sca", "Running SCA scan (Grype)"),
    ("secret|detect-secrets|gitleaks", "Running secret detection"),
    ("hadolint|dockerfile", "Linting Dockerfiles (Hadolint)"),
    ("shellcheck", "Checking shell scripts (ShellCheck)"),
    ("kubesec|kubernetes.*audit|k8s.*scan", "K8s manifest security audit"),
    ("docker.*build|podman.*build|container.*build", "Building container image"),
    ("deploy.*k8s|kubectl.*apply", "Deploying to Kubernetes"),
    ("generat.*report|html.*report|consolidat", "Generating reports"),
    ("archiv|artifact", "Archiving artifacts"),
)


def _hits(rules: tuple[Rule, ...], text: Column) -> Column:
    marks = []
    for rule in rules:
        body = F.substring_index(text, "\n", 1) if rule.first_line else text
        fires = F.lit(True)
        if rule.present is not None:
            fires = fires & find(body, rule.present)
        if rule.absent is not None:
            fires = fires & ~find(body, rule.absent)
        marks.append(
            F.when(fires, F.struct(F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message")))
        )
    return F.array_compact(F.array(*marks))


def apply_rules(files: DataFrame, rules: tuple[Rule, ...], text: str = "content", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """One row per file and rule that fires."""
    return each_struct(files, [*keep], _hits(rules, F.col(text)))


def apply_rule_sets(
    files: DataFrame, rule_sets: dict[str, tuple[Rule, ...]], kind: str = "kind", text: str = "content",
    keep: tuple[str, ...] = ("file",),
) -> DataFrame:
    """Each file meets only the rules of its own kind."""
    expr = None
    for name, rules in rule_sets.items():
        hit = F.col(kind) == name
        expr = F.when(hit, _hits(rules, F.col(text))) if expr is None else expr.when(hit, _hits(rules, F.col(text)))
    return each_struct(files, [*keep, kind], expr)


def matching_lines(files: DataFrame, wanted, keep: tuple[str, ...] = ("project", "path")) -> DataFrame:
    """(…, line_no, line) for lines where ``wanted(line)`` holds, numbered from 1; whole texts are read."""
    rows = each(files, [*keep], lines("content"), "line", "pos")
    return rows.where(wanted(F.col("line"))).select(*keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def _excluded(path: Column, line: Column, fold: bool = False) -> Column:
    """The exclusion words count in the path and in the line itself."""
    pattern = f"(?i){EXCLUDED_WORDS}" if fold else EXCLUDED_WORDS
    return F.concat(F.lit("./"), path, F.lit(":"), line).rlike(pattern)


def credential_lines(files: DataFrame) -> DataFrame:
    """One row per credential word, file and line."""
    any_word = "(?i)" + "|".join(CREDENTIAL_WORDS)
    wanted = files.where(F.col("path").rlike(CREDENTIAL_FILES) & find(F.col("content"), any_word))
    rows = matching_lines(wanted, lambda line: find(line, any_word))
    rows = rows.where(~_excluded(F.col("path"), F.col("line"), fold=True))
    lowered = F.lower("line")
    words = F.filter(F.array(*[F.lit(w) for w in CREDENTIAL_WORDS]), lambda w: lowered.contains(w))
    return each(rows, ["project", "path", "line_no", "line"], words, "pattern")


def env_audit(files: DataFrame) -> DataFrame:
    """Lines of ``.env*`` files, values of sensitive ones masked."""
    wanted = files.where(base_name("path").startswith(".env"))
    wanted = wanted.where(~F.concat(F.lit("./"), "path").rlike(EXCLUDED_WORDS))
    rows = matching_lines(wanted, lambda line: F.lit(True))
    flag = F.when(sensitive_line("line"), "SENSITIVE").otherwise("plain")
    return rows.select("project", "path", "line_no", flag.alias("flag"), redact_env("line").alias("line"))


def gitignore_check(files: DataFrame) -> DataFrame:
    """Per project: PASS when the root .gitignore names .env, FAIL when it does not, WARN without the file."""
    projects = files.select("project", F.lit(False).alias("found"), F.lit(False).alias("named"))
    # the filter on the path comes first, so the text of other files is not looked at
    ignore = files.where(F.col("path") == ".gitignore").select("project", F.lit(True).alias("found"), F.col("content").rlike(r"\.env").alias("named"))
    found, named = F.bool_or("found"), F.bool_or("named")
    status = F.when(named, "PASS").when(found, "FAIL").otherwise("WARN")
    return projects.unionByName(ignore).groupBy("project").agg(status.alias("status"))


def license_files(files: DataFrame) -> DataFrame:
    """Licence files in the root or one level below."""
    near = F.size(F.split("path", "/")) <= 2
    named = base_name("path").rlike(LICENSE_FILES)
    return files.where(near & named & ~F.concat(F.lit("./"), "path").rlike(EXCLUDED_WORDS))


def license_text(text: str | Column) -> Column:
    """The licence a text names, or null."""
    col = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract(col, r"(AGPL-[0-9.]+|MIT|Apache|GNU General Public)( License|\b)", 1)
    return F.nullif(found, F.lit(""))


def hardcoded_ips(files: DataFrame) -> DataFrame:
    """Lines with a dotted quad, except lines that name 0.0.0.0 or 127.0.0.1."""
    wanted = files.where(F.col("path").rlike(ADDRESS_FILES) & F.col("content").rlike(ADDRESS))
    rows = matching_lines(
        wanted, lambda line: line.rlike(ADDRESS) & ~line.contains("0.0.0.0") & ~line.contains("127.0.0.1")
    )
    return rows.where(~_excluded(F.col("path"), F.col("line")))


def routes(files: DataFrame, folder: str = "backend") -> DataFrame:
    """Route decorators in the Python files below ``folder``."""
    wanted = files.where(F.col("path").startswith(f"{folder}/") & F.col("path").endswith(".py"))
    wanted = wanted.where(F.col("content").rlike(ROUTE))
    return matching_lines(wanted, lambda line: line.rlike(ROUTE))


def makefile_targets(files: DataFrame) -> DataFrame:
    """Known targets of each Makefile and the first build, image and scan target among them."""
    wanted = files.where(base_name("path") == "Makefile")
    found = F.array_compact(
        F.array(*[F.when(F.col("content").rlike(rf"(?m)^{t}\s*:"), F.lit(t)) for t in MAKE_TARGETS])
    )

    def first(names: tuple[str, ...]) -> Column:
        hits = F.filter("targets", lambda t: t.isin(*names))
        return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))

    return wanted.withColumn("targets", found).select(
        "project",
        "path",
        "targets",
        first(BUILD_TARGETS).alias("build_target"),
        first(DOCKER_TARGETS).alias("docker_target"),
        first(("scan",)).alias("scan_target"),
    )


def detect_phase(text: str | Column) -> Column:
    """The console phase a text belongs to, null when no rule fits."""
    col = F.col(text) if isinstance(text, str) else text
    expr = None
    for pattern, phase in PHASE_RULES:
        hit = find(col, f"(?i){pattern}")
        expr = F.when(hit, phase) if expr is None else expr.when(hit, phase)
    return expr
