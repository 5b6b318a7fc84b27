"""Inventory of project files: adapters, languages, modules, tests, directories.

Input is a file table (project, path) with ``content`` where a rule looks inside; paths are
relative to the project. All answers are grouped aggregates of flags, so map-side combining
keeps even a huge project from landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.rows import each, each_struct
from scanlake.functions.paths import (
    SKIPPED_DIRS, UPLOAD_SKIPPED_DIRS, base_name, dir_name, outside_skipped_dirs, size_label,
)
from scanlake.operators.rules import EXCLUDED_WORDS
from scanlake.operators.totals import with_group_total

# Adapters in their supported order, with the root files that signal each.
ADAPTERS = ("python", "java", "node-react", "c-cpp", "kotlin", "html-static")
SIGNALS = {
    "python": ("requirements.txt", "pyproject.toml", "setup.py", "Pipfile"),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "node-react": ("package.json",),
    "c-cpp": ("CMakeLists.txt", "Makefile", "makefile"),
    "kotlin": ("build.gradle.kts", "settings.gradle.kts"),
    "html-static": ("index.html",),
}
# Language markers in the order of each detector.
PYTHON_MARKERS = ("requirements.txt", "setup.py", "pyproject.toml", "Pipfile")
MODULE_ORDER = (
    ("java-maven", ("pom.xml",)),
    ("java-gradle", ("build.gradle", "build.gradle.kts")),
    ("angular", ("angular.json",)),
    ("go", ("go.mod",)),
    ("python", PYTHON_MARKERS),
    ("nodejs", ("package.json",)),
)
PYTHON_FIRST_ORDER = (
    ("python", PYTHON_MARKERS),
    ("java-maven", ("pom.xml",)),
    ("java-gradle", ("build.gradle", "build.gradle.kts")),
    ("angular", ("angular.json",)),
    ("react", ("next.config.js", "next.config.mjs")),
    ("vue", ("vue.config.js", "nuxt.config.js")),
    ("nodejs", ("package.json",)),
    ("go", ("go.mod",)),
)
FALLBACK_ORDER = (
    ("python", PYTHON_MARKERS),
    ("java-maven", ("pom.xml",)),
    ("java-gradle", ("build.gradle", "build.gradle.kts")),
    ("angular", ("angular.json",)),
    ("nodejs", ("package.json",)),
    ("go", ("go.mod",)),
)
CI_ORDER = tuple(
    (lang, (*markers, "nuxt.config.ts") if lang == "vue" else markers) for lang, markers in PYTHON_FIRST_ORDER
)
# Fixed values; name: (order, words in package.json that refine nodejs, depth of .csproj files, default)
LANGUAGE_VARIANTS = {
    "module": (MODULE_ORDER, (("react", ('"react"', '"react-dom"')), ("vue", ('"vue"',))), 1, None),
    "python_first": (PYTHON_FIRST_ORDER, (("react", ('"react"',)),), 2, "nodejs"),
    "ci": (CI_ORDER, (("react", ('"react"',)),), 2, "nodejs"),
    "fallback": (FALLBACK_ORDER, (("react", ('"react"',)), ("vue", ('"vue"',))), 3, "python"),
}
# Test naming per language.
TEST_DIR_NAMES = ("tests", "test", "__tests__", "spec", "specs", "e2e")
NODE_LANGUAGES = ("nodejs", "react", "angular", "vue")
JAVA_LANGUAGES = ("java-maven", "java-gradle")
NODE_TEST_FILES = r"\.(test|spec)\.(js|ts|jsx|tsx)$"
INTEGRATION_WORDS = ("integration", "e2e", "functional", "acceptance", "api")
INTEGRATION_SKIPPED_DIRS = ("node_modules", ".git", "pipeline-reports", ".trivy-cache", ".venv", "venv")
# Dependency files per language.
PYTHON_DEPS = (
    "requirements.txt", "requirements-dev.txt", "requirements-test.txt", "setup.py", "pyproject.toml", "Pipfile",
)
PYTHON_DEPS_BELOW = ("requirements.txt", "requirements-dev.txt")
# Extensions of the breakdown and of the line count.
BREAKDOWN_EXTENSIONS = (
    "py", "ts", "tsx", "js", "jsx", "sql", "yaml", "yml", "sh", "ps1", "json", "md", "css", "html",
)
SOURCE_EXTENSIONS = ("py", "ts", "tsx", "js")


def _any(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def with_package_words(files: DataFrame, words: dict[str, Column]) -> DataFrame:
    """(project, path) of all files, and package.json files once more with what their text says.

    Texts are read in the second branch only, behind a filter on the name. Flags are or-ed later, so a second look
    at a file changes nothing.
    """
    plain = files.select("project", "path", *[F.lit(False).alias(name) for name in words])
    named = files.where(base_name("path") == "package.json")
    said = named.select("project", "path", *[F.coalesce(hit, F.lit(False)).alias(name) for name, hit in words.items()])
    return plain.unionByName(said)


def detect_adapters(files: DataFrame) -> DataFrame:
    """(project, adapter, signals): adapters whose signals fire, several per project if need be."""
    path = F.col("path")
    rows = with_package_words(files, {"says_react": F.lower("content").contains("react")})
    root_file = {name: _any(path == name) for names in SIGNALS.values() for name in names}
    react = _any((path == "package.json") & F.col("says_react"))
    c_source = _any(path.rlike(r"\.(c|cpp|cc)$"))
    kotlin_source = _any(path.endswith(".kt"))
    html = _any(path.endswith(".html"))
    flags = rows.groupBy("project").agg(
        F.struct(*[flag.alias(f"f{i}") for i, flag in enumerate(root_file.values())]).alias("root"),
        react.alias("react"),
        c_source.alias("c_source"),
        kotlin_source.alias("kotlin_source"),
        html.alias("html"),
    )
    at = {name: F.col(f"root.f{i}") for i, name in enumerate(root_file)}

    def fired(names) -> Column:
        return F.array_compact(F.array(*[F.when(at[name], F.lit(name)) for name in names]))

    def else_pattern(names, seen: Column, pattern: str) -> Column:
        hits = fired(names)
        return F.when(F.size(hits) > 0, hits).when(seen, F.array(F.lit(pattern))).otherwise(hits)

    signals = {name: fired(SIGNALS[name]) for name in ADAPTERS}
    signals["node-react"] = F.when(
        at["package.json"] & F.col("react"), F.array(F.lit("package.json"), F.lit("react-dependency"))
    ).otherwise(fired(SIGNALS["node-react"]))
    signals["c-cpp"] = F.when(F.col("c_source"), fired(SIGNALS["c-cpp"])).otherwise(F.array().cast("array<string>"))
    signals["kotlin"] = else_pattern(SIGNALS["kotlin"], F.col("kotlin_source"), "*.kt")
    signals["html-static"] = else_pattern(SIGNALS["html-static"], F.col("html"), "*.html")
    pairs = F.array(*[F.struct(F.lit(name).alias("adapter"), signals[name].alias("signals")) for name in ADAPTERS])
    return each_struct(flags, ["project"], pairs).where(F.size("signals") > 0)


def supported_adapters(detected: Column) -> Column:
    """Detected adapters that are supported, in supported order, each once."""
    return F.array_intersect(F.array(*[F.lit(name) for name in ADAPTERS]), detected)


def _refining_words(files: DataFrame, variant: str) -> DataFrame:
    """All paths, and whether package files say the words that refine the variant's nodejs."""
    says = {}
    for lang, words in LANGUAGE_VARIANTS[variant][1]:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.col("content").contains(word)
        says[f"says_{lang}"] = hit
    return with_package_words(files, says)


def _language(rows: DataFrame, keys: list[str], variant: str, path: str) -> DataFrame:
    """One language per group from the marker files that lie directly in it; ``path`` is relative to the group."""
    order, refinements, csproj_depth, default = LANGUAGE_VARIANTS[variant]
    name, keep = base_name(path), ~F.col(path).contains("/")
    near = F.size(F.split(path, "/")) <= csproj_depth
    flags = {lang: _any(keep & name.isin(*markers)) for lang, markers in order}
    for lang, _words in refinements:
        flags[f"as_{lang}"] = _any(keep & (name == "package.json") & F.col(f"says_{lang}"))
    flags["dotnet"] = _any(near & name.endswith(".csproj"))
    grouped = rows.groupBy(*keys).agg(*[flag.alias(f"_{label}") for label, flag in flags.items()])
    expr = None
    for lang, _ in order:
        result = F.lit(lang)
        if lang == "nodejs":
            refined = None
            for better, _words in refinements:
                hit = F.col(f"_as_{better}")
                refined = F.when(hit, better) if refined is None else refined.when(hit, better)
            result = refined.otherwise("nodejs")
        hit = F.col(f"_{lang}")
        expr = F.when(hit, result) if expr is None else expr.when(hit, result)
    expr = expr.when(F.col("_dotnet"), "dotnet").otherwise(F.lit(default))
    return grouped.select(*keys, expr.alias("language"))


def detect_language(files: DataFrame, variant: str = "module") -> DataFrame:
    """(project, language) from the files in the project root."""
    return _language(_refining_words(files, variant), ["project"], variant, "path")


def with_modules(files: DataFrame) -> DataFrame:
    """Each file once for the root module and once for its top directory, with the path inside the module."""
    top = F.substring_index("path", "/", 1)
    inner = F.regexp_replace("path", "^[^/]+/", "")
    below = F.col("path").contains("/") & ~top.isin(*SKIPPED_DIRS) & ~top.startswith(".")
    homes = F.array_compact(
        F.array(
            F.struct(F.lit("root").alias("module"), F.col("path").alias("inner")),
            F.when(below, F.struct(top.alias("module"), inner.alias("inner"))),
        )
    )
    return each_struct(files, ["*"], homes)


def discover_modules(files: DataFrame) -> DataFrame:
    """(project, module, language) for the root and each top directory that shows a language."""
    found = _language(with_modules(_refining_words(files, "module")), ["project", "module"], "module", "inner")
    return found.where(F.col("language").isNotNull())


def _in_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files outside skipped directories, with the language of their modules."""
    visible = with_modules(files).where(outside_skipped_dirs("inner"))
    return visible.join(modules, ["project", "module"])


def test_dirs(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, module, dir): directories that hold tests by the naming rules of the module's language."""
    rows = _in_modules(files, modules)
    own = F.when(dir_name("path") == "", F.lit(".")).otherwise(dir_name("path"))
    # A file shows all directories above it inside its module; name rules look at each of them.
    parts = F.split(dir_name("path"), "/")
    base_depth = F.when(F.col("module") == "root", 0).otherwise(1)
    above = F.when(
        F.size(F.filter(parts, lambda p: p != "")) > base_depth,
        F.transform(
            F.sequence(base_depth + 1, F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
        ),
    ).otherwise(F.array().cast("array<string>"))
    name = base_name("path")
    lang = F.col("language")
    own_hit = (
        F.when(lang == "python", name.startswith("test_") | (base_name(own).isin(*TEST_DIR_NAMES) & (name.endswith("_test.py") | (name == "conftest.py"))))
        .when(lang.isin(*NODE_LANGUAGES), name.rlike(NODE_TEST_FILES))
        .when(lang.isin(*JAVA_LANGUAGES), F.array_contains(parts, "src") & F.array_contains(parts, "test"))
        .when(lang == "go", name.endswith("_test.go"))
        .when(lang == "dotnet", name.contains("Test") & name.endswith(".csproj"))
        .otherwise(False)
    )
    by_name = lang.isin(*NODE_LANGUAGES) | (lang == "dotnet")
    named = F.when(by_name, F.filter(above, lambda d: F.substring_index(d, "/", -1).isin(*TEST_DIR_NAMES))).otherwise(
        F.array().cast("array<string>")
    )
    found = F.concat(F.when(own_hit, F.array(own)).otherwise(F.array().cast("array<string>")), named)
    return each(rows, ["project", "module"], found, "dir").distinct()


def integration_dirs(dirs: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Test directories whose path names an integration kind.

    Modules without one fall back to any directory of that very name, wherever it lies in the module.
    """
    lowered = F.lower("dir")
    hit = F.lit(False)
    for word in INTEGRATION_WORDS:
        hit = hit | lowered.contains(word)
    named = dirs.where(hit)
    visible = with_modules(files).where(outside_skipped_dirs("inner", INTEGRATION_SKIPPED_DIRS, dot_dirs=False))
    parts = F.split(dir_name("path"), "/")
    matches = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
        lambda d: F.substring_index(d, "/", -1).isin(*INTEGRATION_WORDS),
    )
    found = each(visible, ["project", "module"], matches, "dir").distinct()
    # The module's own directory is where its search starts; for the root that is the project itself.
    lacking = modules.select("project", "module").join(named.select("project", "module"), ["project", "module"], "left_anti")
    return named.unionByName(found.join(lacking, ["project", "module"], "left_semi"))


def has_tests(files: DataFrame, languages: DataFrame) -> DataFrame:
    """(project, has_tests): a quick look for test folders and files of the project's language, near the root."""
    path, name = F.col("path"), base_name("path")
    depth = F.size(F.split("path", "/"))

    def under(*folders: str) -> Column:
        return F.substring_index("path", "/", 1).isin(*folders)

    node_file = (depth <= 4) & name.rlike(r"\.test\.(js|ts|jsx|tsx)$|\.spec\.(js|ts)$") & ~path.contains("node_modules")
    dotnet_dir = F.exists(F.slice(F.split(dir_name("path"), "/"), 1, 4), lambda d: d.endswith(".Tests"))
    looks = {
        "python": under("tests", "test") | ((depth <= 3) & name.rlike(r"^test_.*\.py$|_test\.py$")),
        "java": path.startswith("src/test/") | ((depth <= 5) & name.rlike(r"(Test|Tests|IT)\.java$")),
        "node": under("test", "tests", "__tests__", "spec") | node_file,
        "go": (depth <= 5) & name.endswith("_test.go"),
        "dotnet": under("test", "tests") | ((depth <= 4) & name.rlike(r"Test.*\.csproj$")) | dotnet_dir,
        "other": under("test", "tests"),
    }
    # Files fold to one row per project before the language is looked up.
    flags = files.groupBy("project").agg(*[_any(look).alias(family) for family, look in looks.items()])
    lang = F.col("language")
    answer = (
        F.when(lang.isin(*JAVA_LANGUAGES), F.col("java"))
        .when(lang.isin(*NODE_LANGUAGES), F.col("node"))
        .when(lang == "python", F.col("python"))
        .when(lang == "go", F.col("go"))
        .when(lang == "dotnet", F.col("dotnet"))
        .otherwise(F.col("other"))
    )
    return flags.join(languages, "project").select("project", answer.alias("has_tests"))


def dockerfiles(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, module, path) of container build files."""
    name = base_name("path")
    hit = name.isin("Dockerfile", "Containerfile") | name.startswith("Dockerfile.")
    return _in_modules(files, modules).where(hit).select("project", "module", "path").distinct()


def makefiles(files: DataFrame, modules: DataFrame) -> DataFrame:
    rows = _in_modules(files, modules).where(base_name("path") == "Makefile")
    return rows.select("project", "module", "path").distinct()


def dep_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, module, path) of dependency files, in the module's top directory (Python: one level deeper too)."""
    rows = with_modules(files).join(modules, ["project", "module"])
    inner, lang = F.col("inner"), F.col("language")
    depth = F.size(F.split("inner", "/"))
    top, name = depth == 1, base_name("inner")
    sub = F.substring_index("inner", "/", 1)
    one_below = (depth == 2) & ~sub.isin(*SKIPPED_DIRS) & ~sub.startswith(".")
    hit = (
        F.when(lang == "python", (top & inner.isin(*PYTHON_DEPS)) | (one_below & name.isin(*PYTHON_DEPS_BELOW)))
        .when(lang.isin(*NODE_LANGUAGES), inner == "package.json")
        .when(lang == "java-maven", inner == "pom.xml")
        .when(lang == "java-gradle", inner.isin("build.gradle", "build.gradle.kts"))
        .when(lang == "go", inner == "go.mod")
        .when(lang == "dotnet", top & inner.endswith(".csproj"))
        .otherwise(False)
    )
    return rows.where(hit).select("project", "module", "path").distinct()


def remove_root_duplicates(owned: DataFrame) -> DataFrame:
    """The root module gives up the files that a child module owns too.

    A path has at most one child module, its top directory, so one aggregate per path settles it without a join.
    """
    child = F.max(F.when(F.col("module") != "root", F.col("module")))
    owner = F.coalesce(child, F.lit("root")).alias("module")
    return owned.groupBy("project", "path").agg(owner).select("project", "module", "path")


def modules_without(modules: DataFrame, items: DataFrame) -> DataFrame:
    """Modules for which ``items`` (project, module, …) has no row."""
    return modules.join(items.select("project", "module"), ["project", "module"], "left_anti")


def flat_paths(owned: DataFrame) -> DataFrame:
    """All paths over the modules of a project, each once, as rows (a list could outgrow one task)."""
    return owned.select("project", "path").distinct()


def directory_tree(files: DataFrame) -> DataFrame:
    """(project, dir): every directory once; the root shows as ``.``."""
    parts = F.filter(F.split(dir_name("path"), "/"), lambda p: p != "")
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("./"), F.array_join(F.slice(parts, F.lit(1), n), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    # Files of one directory fold before their ancestors are spelt out.
    dirs = files.select("project", dir_name("path").alias("d")).distinct()
    parts_of = F.concat("d", F.lit("/x"))
    rows = dirs.select("project", F.when(F.col("d") == "", F.lit("x")).otherwise(parts_of).alias("path"))
    shown = rows.select("project", F.explode(F.concat(F.array(F.lit(".")), prefixes)).alias("dir")).distinct()
    return shown.where(~F.col("dir").rlike("node_modules|.git|keycloak-24|java17|__pycache__"))


def upload_file_count(files: DataFrame, depth: int = 5) -> DataFrame:
    near = F.size(F.split("path", "/")) <= depth
    kept = near & outside_skipped_dirs("path", UPLOAD_SKIPPED_DIRS, dot_dirs=False)
    return files.groupBy("project").agg(F.count_if(kept).alias("files"))


def file_type_breakdown(files: DataFrame) -> DataFrame:
    """(project, ext, files) for the listed extensions that occur."""
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    rows = files.where(ext.isin(*BREAKDOWN_EXTENSIONS) & ~F.concat(F.lit("./"), "path").rlike(EXCLUDED_WORDS))
    return rows.groupBy("project", ext.alias("ext")).agg(F.count("*").alias("files"))


def lines_of_code(files: DataFrame) -> DataFrame:
    """(project, ext, loc) for source files, and a TOTAL row per project; newlines are counted, as in a word count."""
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    rows = files.where(ext.isin(*SOURCE_EXTENSIONS) & ~F.concat(F.lit("./"), "path").rlike(EXCLUDED_WORDS))
    counts = rows.groupBy("project", ext.alias("ext")).agg(
        F.sum(F.regexp_count("content", F.lit("\n"))).cast("bigint").alias("loc")
    )
    return with_group_total(counts, "project", "ext", ("loc",))


def artifact_family(path: str | Column) -> Column:
    """The heading a report file is listed under."""
    p = F.col(path) if isinstance(path, str) else path
    name = base_name(p)
    return (
        F.when(name.rlike(r"^comprehensive-report\.(html|txt|json)$"), "Comprehensive Reports")
        .when(p.startswith("sbom/"), "SBOM")
        .when(p.startswith("trivy/"), "Trivy")
        .when(name.rlike(r"^pytest-.*\.(xml|html)$"), "Unit Tests")
        .when(name == "secret-scan.json", "Secrets/SAST")
        .when(p.startswith("sonarqube/"), "SonarQube")
        .otherwise("Other")
    )


def artifact_index(files: DataFrame) -> DataFrame:
    """(project, family, path, size): one row per report file, never a list per scan."""
    return files.select("project", artifact_family("path").alias("family"), "path", size_label("length").alias("size"))
