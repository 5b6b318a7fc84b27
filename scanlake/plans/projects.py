"""Queries over the file inventory of projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import inventory, ranking
from scanlake.plans import bindings as b
from scanlake.plans.registry import query
from scanlake.session import staged

MODULES_SQL = f"""{b.FILES_SQL},
homes as (
  select project, doc_id, path, name, content, 'root' as module, path as inner_path from files
  union all select project, doc_id, path, name, content, string_split(path, '/')[1], regexp_replace(path, '^[^/]+/', '') from files where contains(path, '/')),
flags as (
  select project, module, bool_or(inner_path = 'pom.xml') as maven, bool_or(inner_path = 'go.mod') as go, bool_or(inner_path = 'requirements.txt') as py,
    bool_or(inner_path = 'package.json') as node, bool_or(inner_path = 'package.json' and (contains(content, '"react"') or contains(content, '"react-dom"'))) as react,
    bool_or(inner_path = 'package.json' and contains(content, '"vue"')) as vue from homes group by project, module),
modules as (
  select * from (select project, module, case when maven then 'java-maven' when go then 'go' when py then 'python' when node and react then 'react' when node and vue then 'vue' when node then 'nodejs' end as language
  from flags) where language is not null)
"""


def files(spark, sf):
    """Package files name a framework: react in every third one, vue in every fifth."""
    doc = F.col("doc_id")
    head = (
        F.when((F.col("name") == "package.json") & (doc % 3 == 0), '{"react": "18"}')
        .when((F.col("name") == "package.json") & (doc % 5 == 0), '{"vue": "3"}')
        .otherwise("")
    )
    return b.files(spark, sf).withColumn("content", F.concat(head, "content"))


FILES_SQL = MODULES_SQL.replace(
    "text as content,",
    """(case when doc_id % 16 = 2 and doc_id % 3 = 0 then '{"react": "18"}' when doc_id % 16 = 2 and doc_id % 5 = 0 then '{"vue": "3"}' else '' end || text) as content,""",
)


@query(
    "detect_adapters",
    "I1 D4",
    f"""with {FILES_SQL}, f as (
      select project, bool_or(path = 'requirements.txt') as py, bool_or(path = 'pom.xml') as pom, bool_or(path = 'package.json') as node,
        bool_or(path = 'package.json' and contains(lower(content), 'react')) as react, bool_or(path = 'Makefile') as mk, bool_or(name = 'main.cpp') as cpp,
        bool_or(path = 'index.html') as html, bool_or(name = 'index.html') as any_html from files group by project)
    select project, 'python' as adapter, 'requirements.txt' as signals from f where py
    union all select project, 'java', 'pom.xml' from f where pom
    union all select project, 'node-react', case when react then 'package.json,react-dependency' else 'package.json' end from f where node
    union all select project, 'c-cpp', 'Makefile' from f where mk and cpp
    union all select project, 'html-static', case when html then 'index.html' else '*.html' end from f where any_html""",
)
def adapters(spark, sf):
    rows = inventory.detect_adapters(files(spark, sf))
    return rows.select("project", "adapter", F.array_join("signals", ",").alias("signals"))


_NODE = "case when bool_or(path = 'package.json' and contains(content, '\"react\"')) then 'react' {vue} else 'nodejs' end"
_VUE = "when bool_or(path = 'package.json' and contains(content, '\"vue\"')) then 'vue'"
LANGUAGE_SQL = {
    "module": f"""case when bool_or(path = 'pom.xml') then 'java-maven' when bool_or(path = 'go.mod') then 'go' when bool_or(path = 'requirements.txt') then 'python'
      when bool_or(path = 'package.json') then {_NODE.format(vue=_VUE)} end""",
    "python_first": f"""case when bool_or(path = 'requirements.txt') then 'python' when bool_or(path = 'pom.xml') then 'java-maven'
      when bool_or(path = 'package.json') then {_NODE.format(vue='')} when bool_or(path = 'go.mod') then 'go' else 'nodejs' end""",
    "fallback": f"""case when bool_or(path = 'requirements.txt') then 'python' when bool_or(path = 'pom.xml') then 'java-maven'
      when bool_or(path = 'package.json') then {_NODE.format(vue=_VUE)} when bool_or(path = 'go.mod') then 'go' else 'python' end""",
}

LANGUAGE_SQL["ci"] = LANGUAGE_SQL["python_first"]

for _variant, _sql in LANGUAGE_SQL.items():

    @query(f"detect_language_{_variant}", "I2", f"with {FILES_SQL} select project, {_sql} as language from files group by project")
    def language(spark, sf, variant=_variant):
        return inventory.detect_language(files(spark, sf), variant)


@query("discover_modules", "I3", f"with {FILES_SQL} select project, module, language from modules")
def modules(spark, sf):
    return inventory.discover_modules(files(spark, sf))


def modules_of(spark, sf):
    """Files without texts, and the modules, found once however often a query looks at them."""
    table = files(spark, sf)
    return table.drop("content"), staged(inventory.discover_modules(table), "modules")


VISIBLE_SQL = f"""{FILES_SQL}, visible as (
  select h.*, m.language, regexp_replace(h.path, '/?[^/]*$', '') as dir from homes h join modules m using (project, module) where not contains(inner_path, 'node_modules/')),
td as (
  select distinct project, module, case when dir = '' then '.' else dir end as dir from visible where language = 'python' and starts_with(name, 'test_')
  union select distinct project, module, 'web/tests' from visible where language in ('nodejs', 'react', 'vue') and dir = 'web/tests')
"""


@query("test_dirs", "I4", f"with {VISIBLE_SQL} select project, module, dir from td")
def test_dirs(spark, sf):
    return inventory.test_dirs(*modules_of(spark, sf))


@query(
    "integration_dirs",
    "I5",
    f"""with {VISIBLE_SQL}, named as (select project, module, dir || '/e2e' as dir from td where regexp_matches(project, '[0-4]$'))
    select project, module, dir from named
    union select project, module, 'web/api' from homes join modules using (project, module) where starts_with(path, 'web/tests/') and name = 'routes.py'
      and (project, module) not in (select project, module from named)""",
)
def integration_dirs(spark, sf):
    """In half of the projects the test directories are end-to-end folders; route files of the others lie in an api folder."""
    table, found = modules_of(spark, sf)
    suffix = F.when(F.col("project").rlike("[0-4]$"), "/e2e").otherwise("")
    dirs = inventory.test_dirs(table, found).withColumn("dir", F.concat("dir", suffix))
    moved = F.when((F.col("name") == "routes.py") & F.col("path").startswith("web/tests/"), F.lit("web/api/routes.py"))
    return inventory.integration_dirs(dirs, table.withColumn("path", F.coalesce(moved, "path")), found)


@query(
    "has_tests",
    "I4",
    f"""with {FILES_SQL}, l as (select project, {LANGUAGE_SQL["python_first"]} as language from files group by project)
    select project, cast(bool_or(case when language = 'python' then name = 'test_main.py' else false end) as varchar) as has_tests from files join l using (project) group by project""",
)
def has_tests(spark, sf):
    table = files(spark, sf)
    rows = inventory.has_tests(table, inventory.detect_language(table, "python_first"))
    return rows.withColumn("has_tests", F.col("has_tests").cast("string"))


@query("dockerfiles", "I5", f"with {VISIBLE_SQL} select distinct project, module, path from visible where name = 'Dockerfile'")
def dockerfiles(spark, sf):
    return inventory.dockerfiles(*modules_of(spark, sf))


@query(
    "dep_files",
    "I5",
    f"""with {FILES_SQL} select distinct project, module, path from homes join modules using (project, module)
    where (language = 'python' and (inner_path = 'requirements.txt' or (name = 'requirements.txt' and len(string_split(inner_path, '/')) = 2)))
      or (language in ('nodejs', 'react', 'vue') and inner_path = 'package.json') or (language = 'java-maven' and inner_path = 'pom.xml') or (language = 'go' and inner_path = 'go.mod')""",
)
def dep_files(spark, sf):
    return inventory.dep_files(*modules_of(spark, sf))


@query(
    "remove_root_duplicates",
    "J10 D3",
    f"""with {VISIBLE_SQL}, d as (select distinct project, module, path from visible where name in ('Dockerfile'))
    select project, module, path from d where module <> 'root' or not exists (select 1 from d c where c.project = d.project and c.path = d.path and c.module <> 'root')""",
)
def root_duplicates(spark, sf):
    return inventory.remove_root_duplicates(inventory.dockerfiles(*modules_of(spark, sf)))


@query(
    "modules_without_dockerfiles",
    "J12",
    f"""with {VISIBLE_SQL} select project, module, language from modules where not exists (select 1 from visible v where v.project = modules.project and v.module = modules.module and v.name = 'Dockerfile')""",
)
def without_dockerfiles(spark, sf):
    table, found = modules_of(spark, sf)
    return inventory.modules_without(found, inventory.dockerfiles(table, found))


@query(
    "modules_without_tests",
    "J12",
    f"with {VISIBLE_SQL} select project, module, language from modules where (project, module) not in (select project, module from td)",
)
def without_tests(spark, sf):
    table, found = modules_of(spark, sf)
    return inventory.modules_without(found, inventory.test_dirs(table, found))


@query(
    "flat_paths",
    "D2",
    f"with {VISIBLE_SQL} select distinct project, path from visible where name in ('Dockerfile', 'Makefile')",
)
def flat_paths(spark, sf):
    table, found = modules_of(spark, sf)
    return inventory.flat_paths(inventory.dockerfiles(table, found).unionByName(inventory.makefiles(table, found)))


@query(
    "root_minus_children",
    "D3",
    f"""with {FILES_SQL} select distinct project, path from homes where module = 'root' and not contains(path, '/')""",
)
def difference(spark, sf):
    """Set difference of the root's paths and all child paths."""
    rows = inventory.with_modules(b.files(spark, sf).select("project", "path"))
    root = rows.where("module = 'root'").select("project", "path")
    return root.subtract(rows.where("module <> 'root'").select("project", "path"))


@query(
    "dedupe_keep_first",
    "W7",
    f"with {b.FILES_SQL} select project, path, min(doc_id) as doc_id from files group by project, path",
)
def keep_first(spark, sf):
    return ranking.dedupe_keep_first(b.files(spark, sf), ["project", "path"], "doc_id")


@query(
    "primary_language",
    "W8",
    f"""with {FILES_SQL}, p as (select distinct 'src' || s_suppkey as project from supplier)
    select p.project, coalesce(min_by(language, (case when module = 'root' then 'z' else 'a' end) || module), 'python') as language from p left join modules m on m.project = p.project group by p.project""",
)
def primary(spark, sf):
    """Projects are numbered; those without files get the default."""
    projects = b.table(spark, sf, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("project"))
    return ranking.primary_language(inventory.discover_modules(files(spark, sf)), projects)


@query(
    "directory_tree",
    "I6",
    f"""with {b.FILES_SQL} select distinct project, '.' as dir from files
    union select project, './backend' from files where lang = 'fr' union select project, './web' from files where lang in ('de', 'es') union select project, './web/tests' from files where lang = 'de'""",
)
def directory_tree(spark, sf):
    return inventory.directory_tree(b.files(spark, sf))


@query(
    "upload_file_count",
    "I7",
    f"with {b.FILES_SQL} select project, count(*) filter (not contains(path, 'node_modules/')) as files from files group by project",
)
def upload_count(spark, sf):
    return inventory.upload_file_count(b.files(spark, sf))


@query(
    "artifact_index",
    "I8 P14",
    """with a as (select source as project, doc_id, text, case doc_id % 8 when 0 then 'comprehensive-report.txt' when 1 then 'sbom/sbom-' || lang || '.json' when 2 then 'trivy/' || lang || '.json'
        when 3 then 'pytest-' || lang || '.xml' when 4 then 'secret-scan.json' when 5 then 'sonarqube/quality-gate.json' when 6 then 'hadolint.json' else 'gate-results.txt' end as path from documents)
    select project, path, case doc_id % 8 when 0 then 'Comprehensive Reports' when 1 then 'SBOM' when 2 then 'Trivy' when 3 then 'Unit Tests' when 4 then 'Secrets/SAST' when 5 then 'SonarQube' else 'Other' end as family,
      case when strlen(text) > 1024 then format('{:.1f}', strlen(text) / 1024.0) || 'KB' else strlen(text) || 'B' end as size from a""",
)
def artifact_index(spark, sf):
    turn, lang = F.col("doc_id") % 8, F.col("lang")
    path = (
        F.when(turn == 0, "comprehensive-report.txt").when(turn == 1, F.concat(F.lit("sbom/sbom-"), lang, F.lit(".json")))
        .when(turn == 2, F.concat(F.lit("trivy/"), lang, F.lit(".json"))).when(turn == 3, F.concat(F.lit("pytest-"), lang, F.lit(".xml")))
        .when(turn == 4, "secret-scan.json").when(turn == 5, "sonarqube/quality-gate.json").when(turn == 6, "hadolint.json").otherwise("gate-results.txt")
    )
    rows = b.files(spark, sf).withColumn("path", path)
    return inventory.artifact_index(rows)


@query(
    "file_type_breakdown",
    "A17",
    f"""with {b.FILES_SQL} select project, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) as ext, count(*) as files from files
    where regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) in ('py','ts','html','json','yml') and not contains(path, 'node_modules') group by all""",
)
def breakdown(spark, sf):
    return inventory.file_type_breakdown(b.files(spark, sf))


@query(
    "lines_of_code",
    "A18",
    f"""with {b.FILES_SQL}, c as (select project, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) as ext, length(content) - length(replace(content, chr(10), '')) as n from files where not contains(path, 'node_modules'))
    select project, case when grouping(ext) = 1 then 'TOTAL' else ext end as ext, cast(sum(n) as bigint) as loc from c where ext in ('py', 'ts') group by grouping sets ((project, ext), (project))""",
)
def loc(spark, sf):
    return inventory.lines_of_code(b.files(spark, sf))
