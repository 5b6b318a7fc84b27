"""Queries over file texts: paths, labels, content rules, console phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import paths, text
from scanlake.operators import ranking, rules
from scanlake.operators.rules import Rule
from scanlake.plans import bindings as b
from scanlake.plans.registry import query


@query(
    "valid_scan_id",
    "P4",
    """select doc_id, case when regexp_matches(source || '-' || lang || '-' || doc_id, '^[a-zA-Z0-9_\\-]{3,80}$') then 1 else 0 end as plain,
      len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[a-zA-Z0-9_\\-]{3,80}$'))) as words from documents""",
)
def valid_scan_id(spark, sf):
    docs = b.table(spark, sf, "documents")
    plain = F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", text.valid_scan_id(plain).cast("int").alias("plain"),
        F.size(F.filter(F.split("text", " ", -1), lambda word: text.valid_scan_id(word))).cast("bigint").alias("words"),
    )


def shown_paths(spark, sf):
    """Paths in all spellings the filters look at, from the file table."""
    tail = F.element_at(
        F.array(*[F.lit(x) for x in ("report.json", "run.log", "x.tmp", "My-Console-Log.txt", "full-console-log.txt", "a.log.json", ".tmp", ".trivy-cache")]),
        (F.col("doc_id") % 8 + 1).cast("int"),
    )
    return b.files(spark, sf).select("doc_id", "path", F.concat(F.col("path"), F.lit("/"), tail).alias("full"))


SHOWN_SQL = f"""{b.FILES_SQL}, shown as (select doc_id, path, path || '/' ||
  (['report.json','run.log','x.tmp','My-Console-Log.txt','full-console-log.txt','a.log.json','.tmp','.trivy-cache'])[doc_id % 8 + 1] as full_path from files)
"""


@query(
    "artifact_visible",
    "P5",
    f"with {SHOWN_SQL} select doc_id, full_path as path from shown where doc_id % 8 in (0, 5, 6)",
)
def artifact_visible(spark, sf):
    rows = shown_paths(spark, sf).where(paths.artifact_visible("full"))
    return rows.select("doc_id", F.col("full").alias("path"))


@query(
    "safe_relative",
    "P6",
    """with p as (select doc_id, case doc_id % 4 when 0 then 'a/' || lang || '/../..' when 1 then '../' || source when 2 then './' || source || '/../../x/y' else '/' || source end as path from documents)
    select doc_id, path, case when doc_id % 4 = 0 then 'true' else 'false' end as safe from p""",
)
def safe_relative(spark, sf):
    docs = b.table(spark, sf, "documents")
    turn = F.col("doc_id") % 4
    path = (
        F.when(turn == 0, F.concat(F.lit("a/"), "lang", F.lit("/../..")))
        .when(turn == 1, F.concat(F.lit("../"), "source"))
        .when(turn == 2, F.concat(F.lit("./"), "source", F.lit("/../../x/y")))
        .otherwise(F.concat(F.lit("/"), "source"))
    )
    return docs.select("doc_id", path.alias("path")).select("doc_id", "path", paths.safe_relative("path").cast("string").alias("safe"))


@query(
    "exclude_paths",
    "P7",
    f"with {b.FILES_SQL} select doc_id, path from files where not contains(path, 'node_modules/')",
)
def exclude_paths(spark, sf):
    return b.files(spark, sf).where(paths.outside_skipped_dirs("path")).select("doc_id", "path")


@query(
    "cut_titles",
    "P8",
    """select doc_id, case when length(text) > 120 then substr(text, 1, 117) || '...' else text end as title, substr(text, 1, 200) as d200,
      substr(text, 1, 150) as d150, substr(text, 1, 80) as d80 from documents""",
)
def cut_titles(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select(
        "doc_id", text.ellipsis("text", 120).alias("title"), text.cut("text", 200).alias("d200"), text.cut("text", 150).alias("d150"), text.cut("text", 80).alias("d80")
    )


@query("safe_name", "P9", "select page_id, translate(url, '/:', '--') as name from pages")
def safe_name(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", paths.safe_name("url").alias("name"))


@query(
    "short_id",
    "P10",
    """with i as (select o_orderkey, 'user-host-' || case when o_orderstatus = 'F' then cast(epoch(o_orderdate) as bigint)::varchar else o_orderpriority end as id from orders)
    select o_orderkey, case when regexp_matches(id, '\\d{8,}$') then regexp_extract(id, '\\d{8,}$') else substr(id, 1, 12) end as by_prefix,
      case when regexp_matches(id, '\\d{8,}$') then regexp_extract(id, '\\d{8,}$') else substr(md5(id || chr(10)), 1, 12) end as by_md5 from i""",
)
def short_id(spark, sf):
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    tail = F.when(F.col("o_orderstatus") == "F", epoch).otherwise(F.col("o_orderpriority"))
    rows = b.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("user-host-"), tail).alias("id"))
    return rows.select("o_orderkey", text.short_id("id").alias("by_prefix"), text.short_id("id", "md5").alias("by_md5"))


@query(
    "redact_env",
    "P11",
    f"""with {b.FILES_SQL} select doc_id, line_no, case when regexp_matches(line, '(?i)(password|secret|token|key|credential)') then string_split(line, '=')[1] || '=<REDACTED>' else line end as line
    from lines""",
)
def redact_env(spark, sf):
    rows = rules.matching_lines(b.files(spark, sf), lambda line: F.lit(True), ("doc_id",))
    return rows.select("doc_id", "line_no", text.redact_env("line").alias("line"))


@query("redact_values", "P11", "select doc_id, regexp_replace(text, '=.*', '=<REDACTED>', 'g') as content from documents where contains(text, '=')")
def redact_values(spark, sf):
    docs = b.table(spark, sf, "documents").where(F.col("text").contains("="))
    return docs.select("doc_id", text.redact_values("text").alias("content"))


@query(
    "size_label",
    "P14",
    """select doc_id, case when strlen(text) > 1024 then format('{:.1f}', strlen(text) / 1024.0) || 'KB' else strlen(text) || 'B' end as size from documents""",
)
def size_label(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", paths.size_label(F.octet_length("text")).alias("size"))


# Literal rules over web pages: the same operator as the file rules, with patterns that occur.
PAGE_RULES = (
    Rule("INFO", "script", present="<script"),
    Rule("WARN", "ad", present='class="ad"'),
    Rule("LOW", "no footer", absent="<footer"),
    Rule("HIGH", "nav without article", present="<nav", absent="<article"),
    Rule("MEDIUM", "utf8", present="(?i)charset=.UTF-8"),
    Rule("INFO", "no doctype", absent="^<!DOCTYPE", first_line=True),
)


@query(
    "apply_rules",
    "J11",
    """select page_id, 'INFO' as severity, 'script' as message from pages where html like '%<script%'
    union all select page_id, 'WARN', 'ad' from pages where html like '%class="ad"%'
    union all select page_id, 'LOW', 'no footer' from pages where html not like '%<footer%'
    union all select page_id, 'HIGH', 'nav without article' from pages where html like '%<nav%' and html not like '%<article%'
    union all select page_id, 'MEDIUM', 'utf8' from pages where regexp_matches(html, '(?i)charset=.UTF-8')
    union all select page_id, 'INFO', 'no doctype' from pages where not regexp_matches(string_split(html, chr(10))[1], '^<!DOCTYPE')""",
)
def apply_rules(spark, sf):
    return rules.apply_rules(b.table(spark, sf, "pages"), PAGE_RULES, "html", ("page_id",))


def kind_files(spark, sf):
    """Documents as the files the rule sets are made for: a head of typical lines, then the whole text."""
    lang = F.col("lang")
    dockerfile = F.concat(F.when(lang == "en", "FROM base:latest\n").otherwise("FROM base:1.2\nUSER app\n"), F.when(lang == "fr", "ADD x y\nHEALTHCHECK CMD true\n").otherwise(""))
    shell = F.concat(F.when(lang == "en", "").otherwise("#!/bin/sh\n"), F.when(lang == "de", "eval $x\n").otherwise(""))
    manifest = F.concat(
        F.when(lang == "en", "privileged: true\nhostPID: true\n").otherwise("resources:\nsecurityContext:\n readOnlyRootFilesystem: true\n"),
        F.when(lang == "fr", "kind: Secret\nPassword : x\n").when(lang == "de", "runAsUser: 0\nmySecret: y\n").otherwise(""),
    )
    compose = F.concat(
        F.when(lang == "en", "privileged: false\nnetwork_mode: host\n").otherwise("read_only: true\nhealthcheck: x\n"),
        F.when(lang == "es", "mem_limit: 1g\nDB_PASSWORD: z\n").otherwise(""),
    )
    heads = {"dockerfile": dockerfile, "shell": shell, "manifest": manifest, "compose": compose}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("head")) for k, h in heads.items()])
    rows = b.table(spark, sf, "documents").select("doc_id", "text", F.inline(pairs))
    return rows.select("doc_id", "kind", F.concat("head", "text").alias("content"))


RULE_SETS = {
    "dockerfile": rules.DOCKERFILE_RULES, "shell": rules.SHELL_RULES, "manifest": rules.MANIFEST_RULES, "compose": rules.COMPOSE_RULES,
}


# The check SQL of the rules is written out by hand, not made from the tables it checks.
HITS_SQL = """
dockerfile_hits as (
  select doc_id, kind, 'WARN' as severity, 'Uses '':latest'' tag' as message from kind_files where kind = 'dockerfile' and len(list_filter(string_split(content, chr(10)), lambda l: starts_with(l, 'FROM') and contains(l, ':latest'))) > 0
  union all select doc_id, kind, 'WARN', 'No USER instruction' from kind_files where kind = 'dockerfile' and not contains(content, 'USER')
  union all select doc_id, kind, 'INFO', 'Uses ADD' from kind_files where kind = 'dockerfile' and contains(content, 'ADD ')
  union all select doc_id, kind, 'INFO', 'No HEALTHCHECK instruction' from kind_files where kind = 'dockerfile' and not contains(content, 'HEALTHCHECK')),
shell_hits as (
  select doc_id, kind, 'WARN' as severity, 'Missing shebang line' as message from kind_files where kind = 'shell' and not starts_with(content, '#!')
  union all select doc_id, kind, 'WARN', 'Uses eval' from kind_files where kind = 'shell' and contains(content, 'eval ')),
manifest_hits as (
  select doc_id, kind, 'CRITICAL' as severity, 'Running in privileged mode' as message from kind_files where kind = 'manifest' and contains(content, 'privileged: true')
  union all select doc_id, kind, 'HIGH', 'Running as root user' from kind_files where kind = 'manifest' and (contains(content, 'runAsRoot') or contains(content, 'runAsUser: 0'))
  union all select doc_id, kind, 'MEDIUM', 'No resource limits defined' from kind_files where kind = 'manifest' and not contains(content, 'resources:')
  union all select doc_id, kind, 'LOW', 'readOnlyRootFilesystem not set' from kind_files where kind = 'manifest' and not contains(content, 'readOnlyRootFilesystem')
  union all select doc_id, kind, 'HIGH', 'Host namespace sharing enabled' from kind_files where kind = 'manifest' and (contains(content, 'hostNetwork: true') or contains(content, 'hostPID: true') or contains(content, 'hostIPC: true'))
  union all select doc_id, kind, 'MEDIUM', 'No securityContext defined' from kind_files where kind = 'manifest' and not contains(content, 'securityContext:')
  union all select doc_id, kind, 'WARN', 'Possible credential in non-Secret resource' from kind_files where kind = 'manifest' and not contains(content, 'kind: Secret')
    and len(list_filter(string_split(lower(content), chr(10)), lambda l: regexp_matches(l, '(password|secret).*:'))) > 0),
compose_hits as (
  select doc_id, kind, 'CRITICAL' as severity, 'Privileged containers detected' as message from kind_files where kind = 'compose' and contains(content, 'privileged:')
  union all select doc_id, kind, 'HIGH', 'Host network mode used' from kind_files where kind = 'compose' and len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, 'network_mode.*host'))) > 0
  union all select doc_id, kind, 'WARN', 'Hardcoded credentials detected in compose file' from kind_files where kind = 'compose' and len(list_filter(string_split(lower(content), chr(10)), lambda l: regexp_matches(l, '(password|secret).*:'))) > 0
  union all select doc_id, kind, 'INFO', 'No read-only filesystem configuration' from kind_files where kind = 'compose' and not contains(content, 'read_only:')
  union all select doc_id, kind, 'INFO', 'No memory limits set' from kind_files where kind = 'compose' and not contains(content, 'mem_limit') and not contains(content, 'memory:')
  union all select doc_id, kind, 'INFO', 'No healthcheck defined' from kind_files where kind = 'compose' and not contains(content, 'healthcheck:'))
"""


KIND_FILES_SQL = """kind_files as (
  select doc_id, 'dockerfile' as kind, case lang when 'en' then 'FROM base:latest\n' else 'FROM base:1.2\nUSER app\n' end || case lang when 'fr' then 'ADD x y\nHEALTHCHECK CMD true\n' else '' end || text as content from documents
  union all select doc_id, 'shell', case lang when 'en' then '' else '#!/bin/sh\n' end || case lang when 'de' then 'eval $x\n' else '' end || text from documents
  union all select doc_id, 'manifest', case lang when 'en' then 'privileged: true\nhostPID: true\n' else 'resources:\nsecurityContext:\n readOnlyRootFilesystem: true\n' end
    || case lang when 'fr' then 'kind: Secret\nPassword : x\n' when 'de' then 'runAsUser: 0\nmySecret: y\n' else '' end || text from documents
  union all select doc_id, 'compose', case lang when 'en' then 'privileged: false\nnetwork_mode: host\n' else 'read_only: true\nhealthcheck: x\n' end
    || case lang when 'es' then 'mem_limit: 1g\nDB_PASSWORD: z\n' else '' end || text from documents)
"""

for _kind, _id in (("dockerfile", "T6"), ("shell", "T7"), ("manifest", "T8"), ("compose", "T9")):

    @query(f"{_kind}_rules", f"{_id} J11", f"with {KIND_FILES_SQL}, {HITS_SQL} select * from {_kind}_hits")
    def rule_set(spark, sf, kind=_kind):
        files = kind_files(spark, sf).where(F.col("kind") == kind)
        return rules.apply_rule_sets(files, {kind: RULE_SETS[kind]}, keep=("doc_id",))


@query(
    "all_rule_sets",
    "J11 T6 T7 T8 T9",
    f"""with {KIND_FILES_SQL}, {HITS_SQL} select kind, severity, count(*) as n
    from (select * from dockerfile_hits union all select * from shell_hits union all select * from manifest_hits union all select * from compose_hits) group by kind, severity""",
)
def all_rule_sets(spark, sf):
    hits = rules.apply_rule_sets(kind_files(spark, sf), RULE_SETS, keep=("doc_id",))
    return hits.groupBy("kind", "severity").agg(F.count("*").alias("n"))


_EXCLUDED_SQL = "regexp_matches('./' || path || ':' || line, '{}node_modules|.git/|keycloak-24|java17')"


@query(
    "credential_patterns",
    "T1",
    f"""with {b.FILES_SQL}, w as (select unnest(['password', 'secret', 'token', 'api_key', 'private_key', 'passwd', 'credential', 'auth_token', 'access_key', 'secret_key']) as pattern)
    select project, doc_id, path, line_no, pattern, line from lines, w where string_split(path, '.')[-1] in ('py', 'ts', 'tsx', 'js', 'yml', 'yaml', 'env', 'json', 'sh', 'sql', 'md') and contains(path, '.') and contains(lower(line), pattern)
      and not {_EXCLUDED_SQL.format('(?i)')}""",
)
def credential_patterns(spark, sf):
    files = b.files(spark, sf).withColumn("project", F.concat_ws("|", "project", F.col("doc_id").cast("string")))
    rows = rules.credential_lines(files)
    return rows.select(
        F.substring_index("project", "|", 1).alias("project"), F.substring_index("project", "|", -1).cast("bigint").alias("doc_id"),
        "path", "line_no", "pattern", "line",
    )


@query(
    "env_audit",
    "T2 P11",
    f"""with {b.FILES_SQL} select project, path, line_no, case when regexp_matches(line, '(?i)(password|secret|token|key|credential)') then 'SENSITIVE' else 'plain' end as flag,
      case when regexp_matches(line, '(?i)(password|secret|token|key|credential)') then string_split(line, '=')[1] || '=<REDACTED>' else line end as line
    from lines where name = '.env' and not regexp_matches('./' || path, 'node_modules|.git/|keycloak-24|java17')""",
)
def env_audit(spark, sf):
    return rules.env_audit(b.files(spark, sf))


@query(
    "gitignore_check",
    "T3",
    f"""with {b.FILES_SQL} select project, case when bool_or(path = '.gitignore' and regexp_matches(content, '\\.en')) then 'PASS' when bool_or(path = '.gitignore') then 'FAIL' else 'WARN' end as status
    from (select project, path, case when doc_id % 3 = 0 then '.env' || chr(10) || content else replace(content, '.en', '') end as content from files) group by project""",
)
def gitignore_check(spark, sf):
    """Every third file starts with the ignored name."""
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(".env\n"), "content")).otherwise(F.col("content"))
    return rules.gitignore_check(b.files(spark, sf).withColumn("content", content))


@query(
    "license_files",
    "T4",
    f"with {b.FILES_SQL} select doc_id, project, path from files where name = 'LICENSE' and (lang = 'en' or lang = 'fr')",
)
def license_files(spark, sf):
    return rules.license_files(b.files(spark, sf)).select("doc_id", "project", "path")


@query(
    "license_text",
    "T4",
    r"""with l as (select doc_id, regexp_extract(text, '(AGPL-[0-9.]+|MIT|Apache|GNU General Public)( License|\b)', 1) as license from documents)
    select license, count(*) as n from l where license <> '' group by license""",
)
def license_text(spark, sf):
    rows = b.table(spark, sf, "documents").select(rules.license_text("text").alias("license"))
    return rows.where("license is not null").groupBy("license").agg(F.count("*").alias("n"))


def source_files(spark, sf):
    """Document texts as TypeScript files, whole."""
    return b.files(spark, sf).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit("/app.ts")))


IP_SQL = f"""{b.FILES_SQL}, ips as (
  select project, doc_id || '/app.ts' as path, line_no, line from lines where regexp_matches(line, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}')
    and not contains(line, '0.0.0.0') and not contains(line, '127.0.0.1') and not regexp_matches(line, 'node_modules|.git/|keycloak-24|java17'))
"""


@query("hardcoded_ips", "T5", f"with {IP_SQL} select project, path, line_no, line from ips")
def hardcoded_ips(spark, sf):
    return rules.hardcoded_ips(source_files(spark, sf))


@query(
    "leading_hardcoded_ips",
    "W9 T5",
    f"with {IP_SQL} select project, path, line_no from ips qualify row_number() over (partition by project order by path, line_no) <= 50",
)
def leading_ips(spark, sf):
    """The first hits of each project, as in a report that shows only so many."""
    rows = ranking.first_per_key(rules.hardcoded_ips(source_files(spark, sf)), ["project"], ["path", "line_no"], 50)
    return rows.select("project", "path", "line_no")


@query(
    "route_extract",
    "T10",
    f"""with {b.FILES_SQL} select project, doc_id, line_no::bigint as line_no, line from (select project, doc_id, lang, name, unnest(['import x', '@router.get("/a")', 'def a(): ...', '@router.delete("/b/' || doc_id || '")']) as line, unnest([1,2,3,4]) as line_no from files)
    where name in ('routes.py', 'test_main.py') and lang = 'fr' and line like '@router%'""",
)
def route_extract(spark, sf):
    head = F.concat(F.lit('import x\n@router.get("/a")\ndef a(): ...\n@router.delete("/b/'), F.col("doc_id").cast("string"), F.lit('")\n'))
    files = b.files(spark, sf).withColumn("content", F.concat(head, "content"))
    rows = files.select("project", "doc_id", "path", "content")
    found = rules.routes(rows.withColumn("project", F.concat_ws("|", "project", F.col("doc_id").cast("string"))))
    return found.select(
        F.substring_index("project", "|", 1).alias("project"), F.substring_index("project", "|", -1).cast("bigint").alias("doc_id"), "line_no", "line"
    )


@query(
    "makefile_targets",
    "T11",
    f"""with {b.FILES_SQL} select project, path, case when lang = 'en' then 'image,push,build,all' when lang = 'fr' then 'scan,test' else '' end as targets,
      case when lang = 'en' then 'build' else '' end as build_target, case when lang = 'en' then 'image' else '' end as docker_target, case when lang = 'fr' then 'scan' else '' end as scan_target
    from files where name = 'Makefile'""",
)
def makefile_targets(spark, sf):
    lang = F.col("lang")
    head = F.when(lang == "en", "all: build\nbuild :\n\techo\npush:\nimage:\n").when(lang == "fr", "test:\n scan:\nscan\t:\nrescan:\n").otherwise("none\n")
    rows = rules.makefile_targets(b.files(spark, sf).withColumn("content", F.concat(head, "content")))
    return rows.withColumn("targets", F.array_join("targets", ","))


def _phase_sql() -> str:
    """By hand, over the lower-cased lines of a text (a pattern with a gap has to lie within one line)."""
    any_of = lambda *words: "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
    in_line = lambda pattern: f"len(list_filter(string_split(lower(text), chr(10)), lambda l: regexp_matches(l, '{pattern}'))) > 0"
    return f"""case
      when {any_of('checking out', 'clone', 'git')} then 'Checking out source code'
      when {any_of('unit test', 'pytest', 'jest', 'go test', 'mvn test', 'dotnet test')} then 'Running unit tests'
      when {any_of('no tests folder detected')} then 'No test folder detected'
      when {any_of('lint', 'flake8', 'checkstyle', 'golangci')} then 'Running lint & code quality'
      when {any_of('cyclonedx', 'sbom')} then 'Generating SBOM'
      when {any_of('sonarqube', 'sonar-scanner')} then 'Running SonarQube analysis'
      when {any_of('trivy', 'vulnerability scan')} then 'Running vulnerability scan (Trivy)'
      when {any_of('grype', 'sca')} then 'Running SCA scan (Grype)'
      when {any_of('secret', 'gitleaks')} then 'Running secret detection'
      when {any_of('hadolint', 'dockerfile')} then 'Linting Dockerfiles (Hadolint)'
      when {any_of('shellcheck')} then 'Checking shell scripts (ShellCheck)'
      when {any_of('kubesec')} or {in_line('kubernetes.*audit')} or {in_line('k8s.*scan')} then 'K8s manifest security audit'
      when {in_line('(docker|podman|container).*build')} then 'Building container image'
      when {in_line('deploy.*k8s')} or {in_line('kubectl.*apply')} then 'Deploying to Kubernetes'
      when {in_line('generat.*report')} or {in_line('html.*report')} or {any_of('consolidat')} then 'Generating reports'
      when {any_of('archiv', 'artifact')} then 'Archiving artifacts' end"""


PHASE_SQL = f"{b.CHUNKS_SQL}, phases as (select build, \"offset\", {_phase_sql()} as phase from chunks)"


def phase_chunks(spark, sf):
    chunks = b.chunk_rows(b.table(spark, sf, "conversations"))
    return chunks.select("build", "offset", rules.detect_phase("text").alias("phase"))


@query("detect_phase", "T12", f'with {PHASE_SQL} select build, "offset", phase from phases')
def detect_phase(spark, sf):
    return phase_chunks(spark, sf)


@query(
    "detect_phase_documents",
    "T12",
    f"select phase, count(*) as n from (select {_phase_sql()} as phase from documents) group by phase",
)
def detect_phase_documents(spark, sf):
    rows = b.table(spark, sf, "documents").select(rules.detect_phase("text").alias("phase"))
    return rows.groupBy("phase").agg(F.count("*").alias("n"))


CHANGES_SQL = f"""{PHASE_SQL}, marked as (
  select *, lag(phase) over (partition by build order by "offset") as previous from phases where phase is not null)
"""


@query(
    "phase_changes",
    "W6 T12",
    f'with {CHANGES_SQL} select build, "offset", phase, previous from marked where phase is distinct from previous',
)
def phase_changes(spark, sf):
    """The slice span is small here, so that builds do cross slices."""
    return ranking.phase_changes(phase_chunks(spark, sf), span=3.0)
