"""Which part of an index build takes a file, by its path in the repository; and what anchors it gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.globs import Policy, decided, policy_regex
from lodestone.operators.graph import code_symbols

# Names and places of interface descriptions; roots of documents; folders whose files are never taken.
OPENAPI_NAMES = ["openapi.json", "openapi.yaml", "openapi.yml", "swagger.json", "swagger.yaml", "swagger.yml", "api-docs.json"]
OPENAPI_PLACES = ["", "docs/", "api/", "openapi/", "src/main/resources/"]
CONTRACT_ROOTS, ADR_ROOTS, GAP_FILES = ["docs/contracts", "docs/contract"], ["docs/adrs", "docs/adr"], ["docs/known-gaps.md"]
# Parts of paths of Java and Kotlin files that give anchors, and folders that don't.
JAVA_HINTS = [
    "/controllers/", "/controller/", "controller.java", "controllerimpl.java", "/services/", "/service/", "service.java", "serviceimpl.java", "/repository/", "/repositories/", "/jooq/",
    "repository.java", "/specification/", "/mapper/", "mapper.java", "mapperimpl.java", "/config/", "config.java", "configuration.java", "client.java", "filter.java", "/security/",
    "/multitenancy/", "/util/", "/utils/", "helper.java", "resolver.java", "limiter.java", "guard.java", "/entity/", "/entities/", "/ratelimit/",
]
JAVA_DENIED = ["test", "tests", "target", "generated", "build"]
# TypeScript files below a src folder that give anchors, Vue files that do, folders beside src that are skipped.
SCRIPT_GLOBS = [
    "**/*Service.ts", "**/*Page.tsx", "**/*Page.ts", "**/*Store.ts", "**/*Store.tsx", "**/api-client.ts", "**/api-services.ts", "**/http.ts", "**/client.ts", "**/requestSystem.ts", "**/requestAdmin.ts",
    "**/requestNoAuth.ts", "**/requestSystemPortal.ts", "**/baseService.ts", "**/system/types/**/*.ts", "**/global/types/**/*.ts", "**/*Router.ts", "**/*-router.ts", "**/*Repository.ts",
    "**/*-repository.ts", "**/*Middleware.ts", "**/*-middleware.ts", "**/*Factory.ts", "**/*-factory.ts", "**/config.ts", "*/index.ts",
]
VUE_GLOBS = ["**/src/global/components/**/*.vue", "**/src/system/components/**/*.vue", "**/src/views/*.vue"]
SKIPPED_BESIDE_SRC = ["node_modules", "dist", "build", "coverage", "venv", "target", "tests", "test", "__tests__", "vendor", "third_party", "third-party", "fixtures", "examples", "example", "tmp", "temp", "out"]
# Keys of configuration files that are blocks of their own; bytes of an excerpt; lines shown of scripts, tests and configurations.
CONFIG_KEYS = ["api", "auth", "jwt", "spring", "redis", "datasource", "server"]
EXCERPT_BYTES, SCRIPT_LINES, TEST_LINES, CONFIG_LINES = 8192, 120, 160, 80
# Names of script files without exports that are symbols themselves.
STEM_SYMBOL = r"(Service|Page|Store|-router|-repository|-middleware|-factory|Router|Repository|Middleware|Factory)$|^request|^(api-client|api-services|http|client|config|index)$"

_SKIP_BESIDE = "|".join(SKIPPED_BESIDE_SRC).replace("-", r"\-")
_SCRIPTS = "|".join(policy_regex(g).removeprefix("(?s)^(?:").removesuffix(")$") for g in SCRIPT_GLOBS)
_ANY = lambda values: "|".join(v.replace(".", r"\.") for v in values)

#: collector -> (pattern of the path in the repository, pattern of paths it leaves), first match
RULES: dict[str, tuple[str, str | None]] = {
    "openapi": (rf"(?i)^({_ANY(OPENAPI_PLACES)})({_ANY(OPENAPI_NAMES)})$", None),
    "document": (rf"^AGENTS\.md$|^({_ANY(GAP_FILES)})$|^(docs|{_ANY([*CONTRACT_ROOTS, *ADR_ROOTS])})/.*\.md$", r"(^|/)generated/"),
    "java_test": (r"^src/test/java/.*\.(java|kt)$", None),
    "java": (rf"(?i)^src/main/(java|kotlin)/.*\.(java|kt)$", rf"(?i)(^|/)({'|'.join(JAVA_DENIED)})/"),
    "script_test": (r"^([^/]+/)?src/.*\.(test|spec)\.ts$|^(test|tests|__tests__)/.*\.ts$", r"(^|/)node_modules/"),
    "script": (rf"^((?!(?:{_SKIP_BESIDE})/)[^/.][^/]*/)?src/(?:{_SCRIPTS})$", r"(^|/)node_modules/|\.(test|spec)\.tsx?$"),
    "go_test": (r"^(internal|cmd)/.*_test\.go$", None),
    "go": (r"^(internal|cmd)/.*\.go$", r"(^|/)sdk/"),
    "python_test": (r"^tests?/.*\.py$|^test_[^/]*\.py$", r"(^|/)__pycache__/"),
    "python": (r"^src/.*\.py$|^[^/]*\.py$", r"(^|/)test_[^/]*\.py$"),
    "config": (r"^src/main/resources/application\.ya?ml$", None),
    "vue": ("|".join(policy_regex(g).removeprefix("(?s)") for g in VUE_GLOBS), r"(^|/)node_modules/"),
}
LANGUAGE = {"java": "java", "script": "typescript", "go": "go", "python": "python", "config": "yaml", "vue": "vue"}


def collector(path: Column) -> Column:
    """Name of the part that takes the file; null if none does.  Java and Kotlin files must also hold one of the hints."""
    hinted = reduce(lambda a, b: a | b, (F.contains(F.lower(F.concat(F.lit("/"), path)), F.lit(h)) for h in JAVA_HINTS))
    out = F.lit(None).cast("string")
    for name, (pattern, left) in reversed(RULES.items()):
        takes = path.rlike(pattern) & (~path.rlike(left) if left else F.lit(True)) & (hinted if name == "java" else F.lit(True))
        out = F.when(takes, name).otherwise(out)
    return out


def explained(paths: DataFrame, policy: Policy) -> DataFrame:
    """(repo, path, allowed, reason, collector, indexed): what the policy decides on each path and which part takes it."""
    rows = paths.select("repo", "path").distinct().select("repo", "path", decided(F.col("path"), F.col("repo"), policy).alias("d"), collector(F.col("path")).alias("collector"))
    why = F.when(~F.col("d.allowed"), F.col("d.reason")).when(F.col("collector").isNull(), "no_collector").otherwise("indexed")
    return rows.select("repo", "path", "d.allowed", why.alias("reason"), "collector", (F.col("d.allowed") & F.col("collector").isNotNull()).alias("indexed"))


def repo_of(path: Column, repos: dict[str, str]) -> Column:
    """The repository with the longest path that holds the workspace path; the one at ``.`` only if no other does."""
    out = F.lit(next((name for name, place in repos.items() if place in (".", "")), None)).cast("string")
    for name, place in sorted(repos.items(), key=lambda r: len(r[1].rstrip("/"))):
        if place not in (".", ""):
            plain = F.regexp_replace(path, "^/+|/+$", "")
            out = F.when((plain == place.rstrip("/")) | plain.startswith(place.rstrip("/") + "/"), name).otherwise(out)
    return out


def repo_roles(texts: DataFrame) -> DataFrame:
    """(repo, role) from rows ``| **repo** | role |`` of tables in texts; of several roles the last in binary order."""
    row = r"(?m)^\|\s+\*\*([^*\n]+)\*\*\s+\|\s+([^|\n]+)\s+\|"
    cells = lambda n: F.regexp_extract_all("text", F.lit(row), F.lit(n))
    each = texts.select(F.explode(F.arrays_zip(cells(1).alias("repo"), cells(2).alias("role"))).alias("r"))
    return each.select(F.trim("r.repo").alias("repo"), F.trim("r.role").alias("role")).groupBy("repo").agg(F.max("role").alias("role"))


def excerpt(lines: Column, first: Column, most: int = EXCERPT_BYTES) -> Column:
    """STRUCT(text, last): whole lines from line ``first`` on until they reach ``most`` bytes, and the number of the last."""
    near = F.slice(lines, first, F.lit(most))  # a line has a byte at least, its end
    none = F.struct(F.lit(0).alias("n_bytes"), F.lit(0).alias("n"))
    grow = lambda done, line: F.when(done["n_bytes"] >= most, done).otherwise(F.struct((done["n_bytes"] + F.octet_length(line) + 1).alias("n_bytes"), (done["n"] + 1).alias("n")))
    taken = F.aggregate(near, none, grow)["n"]
    return F.struct(F.array_join(F.slice(near, F.lit(1), taken), "\n").alias("text"), (first + F.greatest(taken, F.lit(1)) - 1).alias("last"))


def symbol_excerpts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, symbol, symbol_kind, line_start, line_end, excerpt) of symbols with their lines."""
    texts = files.where("text is not null").select("repo", "path", F.split(F.regexp_replace("text", r"\n\z", ""), "\n").alias("_lines")).dropDuplicates(["repo", "path"])
    same = symbols["repo"].eqNullSafe(texts["repo"]) & (symbols["path"] == texts["path"])
    rows = symbols.join(texts, same).select(symbols["repo"], symbols["path"], "symbol", "symbol_kind", F.col("line").alias("line_start"), excerpt(F.col("_lines"), F.col("line")).alias("_e"))
    return rows.select("repo", "path", "symbol", "symbol_kind", "line_start", F.col("_e.last").alias("line_end"), F.col("_e.text").alias("excerpt"))


def _stem() -> Column:
    """Name of the file without its ending."""
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")


def _whole_file(rows: DataFrame, symbols: Column, kind: Column, language: Column, most_lines: int) -> DataFrame:
    """Anchors that show the head of their file."""
    each = rows.select("repo", "path", F.explode(F.array_distinct(symbols)).alias("symbol"), "text", language.alias("language"))
    lines = F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))
    return each.select("repo", "path", "symbol", kind.alias("anchor_type"), "language", F.lit(1).alias("line_start"), F.least(lines, F.lit(most_lines)).alias("line_end"), F.left("text", F.lit(EXCERPT_BYTES)).alias("excerpt"))


def anchors(files: DataFrame, type_of: Column) -> DataFrame:
    """(repo, path, symbol, anchor_type, language, line_start, line_end, excerpt) of all code and test files that a part takes.

    Java, Kotlin, Go and Python give their classes, types and functions with the lines that follow;
    scripts their exports, or their file's name, with the head of the file, as tests, Vue components
    and configurations without known keys do.  ``type_of`` is the type of a Java symbol.
    """
    taken = files.where("text is not null").select("repo", "path", "text").dropDuplicates(["repo", "path"]).withColumn("_c", collector(F.col("path")))
    none = F.array().cast("array<string>")
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE.items() for x in pair))

    lined = taken.where(F.col("_c").isin("java", "go", "python")).withColumn("language", F.try_element_at(known, F.col("_c")))
    symbols = code_symbols(lined).where(~F.col("symbol").rlike("^_"))
    code = symbol_excerpts(lined, symbols)
    ending = F.element_at(F.split("path", r"\."), -1)
    kind = F.when(ending.isin("java", "kt"), type_of).when(ending == "go", F.when(F.col("symbol_kind") == "function", "go_func").otherwise("go_type")).when(F.col("symbol").endswith("Service"), "service").otherwise("python_type")
    language = F.when(ending.isin("java", "kt"), "java").when(ending == "go", "go").otherwise("python")
    code = code.select("repo", "path", "symbol", kind.alias("anchor_type"), language.alias("language"), "line_start", "line_end", "excerpt")

    types = all_of(r"export\s+(?:type|interface)\s+(\w+)")
    exports = F.concat(all_of(r"export\s+(?:default\s+)?class\s+(\w+)"), all_of(r"export\s+(?:async\s+)?(?:const|function)\s+(\w+)"), types)
    stem = F.when(_stem().rlike(STEM_SYMBOL), F.array(F.when(_stem().rlike("(Service|Page|Store)$|^request"), _stem()).otherwise(F.translate(_stem(), "-", "_")))).otherwise(none)
    low = F.lower(F.concat(F.lit("/"), "path"))
    script_type = (
        F.when(F.contains(F.concat(F.lit("/"), "path"), F.lit("/types/")) | F.array_contains(types, F.col("symbol")), "ts_type").when(F.col("symbol").endswith("Page"), "ts_page").when(F.col("symbol").endswith("Store"), "ts_store")
        .when(F.contains(F.lower("symbol"), F.lit("router")) | F.lower(_stem()).endswith("router") | low.rlike("/routers?/|/routes/"), "ts_router").otherwise("ts_service")
    )
    scripts = _whole_file(taken.where("_c = 'script'"), F.when(F.size(exports) > 0, exports).otherwise(stem), script_type, F.lit("typescript"), SCRIPT_LINES)

    in_test = F.when(ending.isin("java", "kt"), all_of(r"(?m)^\s*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)")).when(ending == "go", all_of(r"(?m)^func\s+(\w+)\s*\("))
    in_test = in_test.when(ending == "py", F.filter(all_of(r"(?m)^class\s+(\w+)"), lambda s: ~s.startswith("_"))).otherwise(F.concat(all_of(r"export\s+(?:default\s+)?class\s+(\w+)"), all_of(r"export\s+(?:async\s+)?(?:const|function)\s+(\w+)")))
    tests = _whole_file(taken.where(F.col("_c").endswith("_test")), F.when(F.size(in_test) > 0, in_test).otherwise(F.array(_stem())), F.lit("test"), ending, TEST_LINES)

    vue = _whole_file(taken.where("_c = 'vue'").where(_stem().rlike(X.PASCAL)), F.array(_stem()), F.lit("vue_component"), F.lit("vue"), SCRIPT_LINES)
    config = taken.where("_c = 'config'")
    block = r"(?m)^(?i:" + "|".join(CONFIG_KEYS) + r"):[ \t]*$(?:\n(?![a-zA-Z][\w-]*:[ \t]*$).*)*"
    found = F.regexp_extract_all("text", F.lit(block), F.lit(0))
    blocks = config.where(F.size(found) > 0).select("repo", "path", F.explode(found).alias("b"))
    yaml = blocks.select("repo", "path", F.concat(F.lit("application-"), F.split("b", ":")[0]).alias("symbol"), F.lit("yaml_block").alias("anchor_type"), F.lit("yaml").alias("language"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.col("b").alias("excerpt"))
    plain = _whole_file(config.where(F.size(found) == 0), F.array(_stem()), F.lit("config"), F.lit("yaml"), CONFIG_LINES)
    return code.unionByName(scripts).unionByName(tests).unionByName(vue).unionByName(yaml).unionByName(plain)
