"""Repository metrics: fourteen dimensions over a table of files and one of commits.

``files``: repo_id, path, file_pos, size, content (null where it wasn't read). One pass over the
contents and one over the paths make all flags and counts; each dimension is a struct of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals
from ..functions import numeric as N
from ..functions import text as T
from . import velocity as V
from .decisions import first_of
from .sequence import top_by

# Limits, extensions, path and content patterns that results depend on.

MAX_FILES, MAX_FILE_SIZE = 10_000, 100_000
SOURCE_EXTENSIONS = (".rb", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".kt", ".swift", ".c", ".cpp", ".h")
SKIPPED_DIRS = r"^(?:\.git|node_modules|vendor|\.bundle)/|/node_modules/|/vendor/bundle/"
TEST_FILE = r"(?:test|spec|__tests__)/|[._](?:test|spec)\.\w+$"
TEST_FRAMEWORKS = {"rspec": r"spec.*_spec\.rb$", "jest": r"\.test\.[jt]sx?$", "pytest": r"test_.*\.py$", "minitest": r"test.*_test\.rb$", "go_test": r"_test\.go$", "bats": r"\.bats$"}
RUBY = {"bare": r"(?m)rescue\s*($|\s*=>)", "standard": r"(?U)rescue\s+(?:StandardError|Exception)\b", "specific": r"(?U)rescue\s+[A-Z]\w+(?:::\w+)*(?:\s*,\s*[A-Z]\w+(?:::\w+)*)*"}
PYTHON = {"bare": r"except\s*:", "standard": r"except\s+Exception", "specific": r"(?U)except\s+[A-Z]\w+"}
JS_CATCH, JS_EXTENSIONS = r"(?U)catch\s*\(\s*\w+\s*\)", (".js", ".jsx", ".ts", ".tsx")
HANDLING_EXTENSIONS = tuple(e for e in SOURCE_EXTENSIONS if e != ".h")
RETRY = r"(?i)retry|retries|backoff|exponential"
SECURITY = {
    "eval_usage": r"(?U)\beval\s*\(", "exec_usage": r"(?U)\b(?:exec|system|popen|spawn)\s*\(", "sql_interpolation_count": r'(?U)\bwhere\s*\(\s*"[^"]*#\{',
    "hardcoded_secret_patterns": r"""(?i)(?:password|secret|api_key|token)\s*=\s*["'][^"']{8,}["']""",
}
SECURITY_CONFIG = r"(?i)security|cors|csp|rack.attack|rate.limit"
PERFORMANCE = {
    "has_caching": r"(?i)cache|memoize|Rails\.cache|redis", "has_indexing": r"(?iU)\badd_index\b|\bcreate_index\b|\bADD INDEX\b", "has_pagination": r"(?id)paginate|pagy|kaminari|will_paginate|limit.*offset",
    "has_connection_pooling": r"(?i)connection_pool|pool_size|ConnectionPool", "has_eager_loading": r"(?i)includes\(|preload\(|eager_load\(",
}
PRODUCTION_PATHS = {"has_error_tracking": r"(?i)sentry|bugsnag|rollbar|honeybadger|airbrake", "has_health_check": r"(?i)health|ping|heartbeat", "has_rate_limiting": r"(?i)rack.attack|rate.limit|throttle", "has_env_config": r"\.env\.example|\.env\.sample|env\.yml"}
PRODUCTION_CONTENTS = {"has_error_tracking": r"(?i)Sentry|Bugsnag|Rollbar|Honeybadger", "has_logging": r"(?i)logger|Rails\.logger|console\.log|logging", "has_health_check": r"(?i)health_check|healthz|readiness", "has_rate_limiting": r"(?i)Rack::Attack|rate_limit|throttle"}
INFRASTRUCTURE = {"docker": ("Dockerfile", "docker-compose"), "ci": (".github/workflows", ".circleci", "Jenkinsfile"), "terraform": (".tf",), "kubernetes": ("k8s", "kubernetes"), "monitoring": ("datadog", "sentry", "newrelic")}
LOCKFILE = r"(?i)Gemfile\.lock|package-lock\.json|yarn\.lock|pnpm-lock|poetry\.lock|go\.sum"
GEM_FRAMEWORKS, NODE_FRAMEWORKS = ("rails", "sinatra", "rspec", "minitest", "sidekiq"), ("react", "next", "vue", "express", "jest", "typescript")
AGENT_CONFIGS = {
    "claude_code": (("CLAUDE.md", ".claude/CLAUDE.md"), None, "markdown"), "codex": (("AGENTS.md", "agents.md", "codex.md", "CODEX.md"), None, "markdown"), "cursor": ((".cursorrules",), r"^\.cursor/rules/[^/]*\.mdc$", "markdown"),
    "windsurf": ((".windsurfrules",), None, "markdown"), "github_copilot": ((".github/copilot-instructions.md",), None, "markdown"), "aider": ((".aider.conf.yml",), None, "yaml"), "continue_dev": ((".continuerc.json", ".continue/config.json"), None, "json"),
}
CONSTRAINT = r"(?iuU)\bNEVER\b|\bALWAYS\b|\bMUST\b|\bDO NOT\b|\bREQUIRED\b|\bSHALL\b|\bIMPORTANT:|\bENSURE\b"
ARCHITECTURE = {
    "rails": {
        "services": r"\Aapp/services/.+\.rb\z", "jobs": r"\Aapp/jobs/.+\.rb\z", "models": r"\Aapp/models/(?!concerns/).+\.rb\z", "controllers": r"\Aapp/controllers/.+_controller\.rb\z",
        "views": r"\Aapp/views/.+\.(?:erb|haml|slim|jbuilder)\z", "concerns": r"\Aapp/(?:models|controllers)/concerns/.+\.rb\z", "helpers": r"\Aapp/helpers/.+\.rb\z", "channels": r"\Aapp/channels/.+\.rb\z",
        "mailers": r"\Aapp/mailers/.+\.rb\z", "middleware": r"\Aapp/middleware/.+\.rb\z", "serializers": r"\Aapp/serializers/.+\.rb\z", "validators": r"\Aapp/validators/.+\.rb\z",
        "decorators": r"\Aapp/decorators/.+\.rb\z", "policies": r"\Aapp/policies/.+\.rb\z", "components": r"\Aapp/components/.+\.rb\z",
    },
    "go": {"commands": r"\Acmd/[^/]+/main\.go\z", "packages": r"\Ainternal/[^/]+/[^/]+\.go\z", "handlers": r"handler[s]?/[^/]+\.go\z", "middleware": r"middleware/[^/]+\.go\z", "models": r"model[s]?/[^/]+\.go\z"},
    "python": {"models": r"models?/[^/]+\.py\z", "views": r"views?/[^/]+\.py\z", "services": r"services?/[^/]+\.py\z", "tasks": r"tasks?/[^/]+\.py\z", "serializers": r"serializers?/[^/]+\.py\z", "middleware": r"middleware/[^/]+\.py\z"},
    "node": {
        "routes": r"routes?/[^/]+\.[jt]sx?\z", "controllers": r"controllers?/[^/]+\.[jt]sx?\z", "services": r"services?/[^/]+\.[jt]sx?\z", "models": r"models?/[^/]+\.[jt]sx?\z",
        "middleware": r"middleware/[^/]+\.[jt]sx?\z", "components": r"components?/[^/]+\.[jt]sx?\z",
    },
    "generic": {
        "services": r"\A(?!(?:test|spec|__tests__)/)[^/]*/services?/[^/]+\.\w+\z", "models": r"\A(?!(?:test|spec|__tests__)/)[^/]*/models?/[^/]+\.\w+\z",
        "controllers": r"\A(?!(?:test|spec|__tests__)/)[^/]*/controllers?/[^/]+\.\w+\z",
    },
}
DOC_DIRS = (r"(?i)(?:test|spec|__tests__|evals?)/", r"(?i)(?:node_modules|vendor|\.github)/")


def discovered(files: DataFrame) -> DataFrame:
    """Files outside version control and vendored folders, with ext, is_test and is_source."""
    f = files.where(~F.col("path").rlike(SKIPPED_DIRS))
    return f.withColumns({"ext": T.extension(F.col("path")), "is_test": F.col("path").rlike(TEST_FILE)}).withColumn("is_source", F.col("ext").isin(*SOURCE_EXTENSIONS))


def readable(found: DataFrame, most: int | None = MAX_FILES) -> DataFrame:
    """The first ``most`` sources of a repository by position, whose contents count (None: all), and of them those small enough to have been read."""
    first = found.where("is_source")
    if most is not None:
        first = top_by(first, ["repo_id"], ["file_pos"], most, "__n").drop("__n")
    return first.withColumn("content", F.when(F.col("size") <= MAX_FILE_SIZE, F.col("content")))


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def _handling(kinds: dict[str, str]) -> tuple[Column, Column]:
    """(generic, specific) handlers; specific ones don't include the standard ones."""
    n = {k: literals.count(F.col("content"), p) for k, p in kinds.items()}
    return n["bare"] + n["standard"], F.greatest(n["specific"] - n["standard"], F.lit(0))


def contents(found: DataFrame, most: int | None = MAX_FILES) -> DataFrame:
    """One row a repository: everything that needs file contents, in one aggregate; ``most``: see :func:`readable`."""
    r = readable(found, most)
    has, lines = F.col("content").isNotNull(), F.coalesce(T.n_lines(F.col("content")), F.lit(0))
    rg, rs = _handling(RUBY)
    pg, ps = _handling(PYTHON)
    generic = F.when(F.col("ext") == ".rb", rg).when(F.col("ext") == ".py", pg).otherwise(0)
    specific = F.when(F.col("ext") == ".rb", rs).when(F.col("ext") == ".py", ps).when(F.col("ext").isin(*JS_EXTENSIONS), F.regexp_count("content", F.lit(JS_CATCH))).otherwise(0)
    r = r.withColumns({"lines": lines, "generic": F.when(has, generic).otherwise(0), "specific": F.when(has, specific).otherwise(0)})
    prod = has & ~F.col("is_test")
    return r.groupBy("repo_id").agg(
        F.struct(
            F.avg("lines").alias("avg"), F.median("lines").alias("median"), F.count_if(F.col("lines") > 500).alias("god_object_count"), F.count_if(F.col("lines") > 300).alias("long_file_count"), F.max("lines").alias("max_file_length"),
            F.sum(F.when(F.col("is_test"), F.col("lines")).otherwise(0)).alias("test_loc"), F.sum(F.when(~F.col("is_test"), F.col("lines")).otherwise(0)).alias("prod_loc"),
        ).alias("length"),
        F.struct(F.sum("generic").alias("rescue_generic"), F.sum("specific").alias("rescue_specific"), _any(F.col("ext").isin(*HANDLING_EXTENSIONS) & F.col("content").rlike(RETRY)).alias("has_retry_logic")).alias("handling"),
        F.struct(*[F.sum(F.when(prod, literals.count(F.col("content"), p)).otherwise(0)).alias(n) for n, p in SECURITY.items()]).alias("security"),
        F.struct(*[_any(literals.matches(F.col("content"), p)).alias(n) for n, p in PERFORMANCE.items()]).alias("performance"),
        F.struct(*[_any(literals.matches(F.col("content"), p)).alias(n) for n, p in PRODUCTION_CONTENTS.items()]).alias("production"),
    )


def paths(found: DataFrame) -> DataFrame:
    """One row a repository: everything that paths alone tell."""
    p = F.col("path")
    doc = (p.rlike(r"(?i)\.md\z") | p.rlike(r"(?i)\AREADME")) & ~p.rlike(DOC_DIRS[0]) & ~p.rlike(DOC_DIRS[1])
    has = lambda words: _any(first_of([(F.contains(p, F.lit(w)), F.lit(True)) for w in words], F.lit(False)))
    top = F.when(F.col("is_test"), T.top_component(p))
    kind = first_of(
        [(has(["Gemfile"]) & has(["app/"]), "rails"), (has(["go.mod", "go.sum"]), "go"), (has(["requirements.txt", "pyproject.toml", "setup.py"]), "python"), (has(["package.json"]), "node")], "generic"
    )
    parts = {f: F.struct(*[F.count_if(p.rlike(rx)).alias(n) for n, rx in table.items()]).alias(f) for f, table in ARCHITECTURE.items()}
    shown = F.slice(F.transform(F.sort_array(F.collect_list(F.when(doc, F.struct("file_pos", "path")))), lambda x: x.path), 1, 30)
    return found.groupBy("repo_id").agg(
        F.count("*").alias("n_files"), F.count_if("is_source").alias("total_source_files"), kind.alias("project_framework"), F.struct(*parts.values()).alias("architecture"),
        F.struct(
            F.count_if("is_test").alias("test_file_count"), F.count_distinct(top).alias("test_dirs"), _any(p.rlike(r"factories/|factory\.")).alias("has_factories"), _any(p.rlike("fixtures/|fixture")).alias("has_fixtures"),
            F.struct(*[_any(p.rlike(rx)).alias(n) for n, rx in TEST_FRAMEWORKS.items()]).alias("frameworks"),
        ).alias("tests"),
        F.struct(
            F.count_if(doc).alias("doc_count"), shown.alias("docs"), _any(p.rlike(r"(?i)\AREADME")).alias("has_readme"), _any(p.rlike(r"(?i)\ACHANGELOG")).alias("has_changelog"),
            _any(doc & p.rlike("(?i)architect")).alias("has_architecture_doc"), _any(doc & p.rlike("(?i)design")).alias("has_design_docs"), _any(doc & p.rlike("(?i)testing")).alias("has_testing_doc"),
        ).alias("documentation"),
        F.struct(*[has(w).alias(f"has_{n}") for n, w in INFRASTRUCTURE.items()], F.lit(False).alias("has_linter")).alias("infrastructure"),
        _any(p.rlike(SECURITY_CONFIG) & ~F.col("is_test")).alias("has_security_config"), _any(p.rlike(LOCKFILE)).alias("has_lockfile"),
        F.struct(*[_any(p.rlike(rx)).alias(n) for n, rx in PRODUCTION_PATHS.items()]).alias("production_paths"),
    )


def dependencies(files: DataFrame) -> DataFrame:
    """(repo_id, dependency_count, frameworks) from the two manifests that are read."""
    small = F.when(F.col("size") <= MAX_FILE_SIZE, F.col("content"))
    m = files.where(F.col("path").isin("Gemfile", "package.json")).groupBy("repo_id").agg(F.max(F.when(F.col("path") == "Gemfile", small)).alias("gem"), F.max(F.when(F.col("path") == "package.json", small)).alias("node"))
    keys = lambda k: F.coalesce(F.size(F.json_object_keys(F.get_json_object("node", f"$.{k}"))), F.lit(0))
    n = F.coalesce(F.regexp_count("gem", F.lit(r"(?m)^\s*gem\s+")), F.lit(0)) + F.greatest(keys("dependencies"), F.lit(0)) + F.greatest(keys("devDependencies"), F.lit(0))
    named = [*[F.when(F.contains("gem", F.lit(w)), F.lit(w)) for w in GEM_FRAMEWORKS], *[F.when(F.contains("node", F.lit(w)), F.lit(w)) for w in NODE_FRAMEWORKS]]
    return m.select("repo_id", n.cast("long").alias("dependency_count"), F.array_distinct(F.array_compact(F.array(*named))).alias("frameworks"))


def agent_configs(files: DataFrame) -> DataFrame:
    """(repo_id, tools, words, constraints) of configuration files of coding agents, and the counts of the main one's rules."""
    p = F.col("path")
    cases = [(p.isin(*names) | (p.rlike(glob) if glob else F.lit(False)), F.struct(F.lit(i).alias("rank"), F.lit(tool).alias("tool"), F.lit(kind).alias("kind"))) for i, (tool, (names, glob, kind)) in enumerate(AGENT_CONFIGS.items())]
    f = files.where(F.col("content").isNotNull() & (F.col("size") <= MAX_FILE_SIZE)).withColumn("t", first_of(cases, F.lit(None))).where("t is not null")
    words = F.size(T.words_leading(F.col("content")))
    limits = F.when(F.col("t.kind") == "markdown", F.regexp_count("content", F.lit(CONSTRAINT))).otherwise(0)
    main = F.when(F.col("t.tool") == "claude_code", F.when(p == "CLAUDE.md", 0).otherwise(1))
    rules = F.size(F.filter(F.split("content", "\r\n|\n|\r"), lambda x: F.ltrim(x).rlike(r"\A[-*1-9]")))
    count = lambda w: F.regexp_count("content", F.lit(rf"(?iuU)\b{w}\b"))
    own = F.struct(words.alias("word_count"), T.n_lines(F.col("content")).alias("line_count"), rules.alias("rules_count"), count("NEVER").alias("never_count"), count("ALWAYS").alias("always_count"), count("MUST").alias("must_count"), F.regexp_count("content", F.lit(CONSTRAINT)).alias("explicit_constraints"))
    return f.groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("t.rank", "t.tool"))), lambda x: x.tool).alias("tools_configured"), F.sum(words).alias("total_word_count"), F.sum(limits).alias("total_constraint_count"), F.min_by(own, main).alias("rules")
    )


#: The dimensions, each a struct of :func:`analyse`.
DIMENSIONS = (
    "commit_discipline", "test_quality", "code_quality", "error_handling", "security_signals", "architecture", "documentation", "agent_configs", "infrastructure", "dependencies", "git_workflow", "code_evolution", "performance", "production_readiness",
)


def evaluated(analysed: DataFrame) -> dict:
    """status, dimensions and the framework of one repository's row. If a part can't be computed, each is computed alone and the failing ones say so."""
    try:
        row = analysed.first()
        if row is None:
            return {"status": "empty_repo", "dimensions": {}}
        return {"status": "complete", "project_framework": row.project_framework, "dimensions": {d: row[d].asDict(True) for d in DIMENSIONS}}
    except Exception:
        found = {}
        for d in DIMENSIONS:
            try:
                found[d] = analysed.select(d).first()[0].asDict(True)
            except Exception as e:
                found[d] = {"status": "error", "error": type(e).__name__}
        if all(x.get("status") == "error" for x in found.values()):
            return {"status": "error", "dimensions": {}}
        return {"status": "complete", "dimensions": found}


def profile(quality: dict) -> dict:
    """What the dimensions tell of the repository itself; only the status of one that has none."""
    if quality["status"] != "complete":
        return {"status": quality["status"]}
    d = quality["dimensions"]
    part = lambda name, key: d.get(name, {}).get(key)
    return {
        "project_framework": quality.get("project_framework"), "frameworks": part("dependencies", "frameworks") or [], "dependency_count": part("dependencies", "dependency_count") or 0,
        "claude_md_stats": part("agent_configs", "rules"), "agent_config_stats": {k: v for k, v in d.get("agent_configs", {}).items() if k != "rules"},
        "architecture_signals": {c["component"]: c["n"] for c in part("architecture", "components") or []},
        "documentation": d.get("documentation", {}), "infra_signals": {k.removeprefix("has_"): True for k, on in d.get("infrastructure", {}).items() if on is True},
    }


def analyse(files: DataFrame, commits: DataFrame, numstat: DataFrame, most: int | None = MAX_FILES) -> DataFrame:
    """One row a repository: status, profile and the fourteen dimensions as structs. Nothing can raise: missing inputs leave nulls. ``most``: see :func:`readable`."""
    found = discovered(files)
    d = V.discipline(V.sizes(commits, numstat), ["repo_id"])
    n = lambda a, b: F.round(N.ratio(F.col(a), F.col(b)), 3)
    out = paths(found).join(contents(found, most), "repo_id", "left").join(dependencies(files), "repo_id", "left").join(agent_configs(files), "repo_id", "left").join(d, "repo_id", "left")
    arch = first_of([(F.col("project_framework") == f, F.array_compact(F.array(*[F.when(F.col(f"architecture.{f}.{k}") > 0, F.struct(F.lit(k).alias("component"), F.col(f"architecture.{f}.{k}").alias("n"))) for k in table]))) for f, table in ARCHITECTURE.items()], F.lit(None))
    out = out.withColumn("components", arch)
    total = F.aggregate("components", F.lit(0).cast("long"), lambda a, x: a + x.n)
    handled = F.col("handling.rescue_generic") + F.col("handling.rescue_specific")
    return out.select(
        "repo_id", F.when(F.col("n_files") > 0, "complete").otherwise("empty_repo").alias("status"), "project_framework",
        F.struct("total_commits", n("conventional", "total_commits").alias("conventional_commit_ratio"), n("reverts", "total_commits").alias("revert_ratio"), n("atomic", "total_commits").alias("atomic_commit_ratio"), "avg_commit_size_lines").alias("commit_discipline"),
        F.struct("tests.*", n("length.test_loc", "length.prod_loc").alias("test_ratio")).alias("test_quality"),
        F.struct("total_source_files", N.half_up(F.col("length.avg")).alias("avg_file_length"), N.half_up(F.col("length.median")).alias("median_file_length"), "length.god_object_count", "length.long_file_count", "length.max_file_length").alias("code_quality"),
        F.struct(handled.alias("rescue_total"), "handling.*", F.round(N.ratio(F.col("handling.rescue_generic"), handled), 3).alias("bare_rescue_ratio")).alias("error_handling"),
        F.struct("security.*", "has_security_config").alias("security_signals"),
        F.struct("components", total.alias("total_components"), F.size("components").alias("component_types"), (F.size("components") >= 3).alias("has_separation_of_concerns")).alias("architecture"),
        F.struct("documentation.*").alias("documentation"),
        F.struct(F.coalesce(F.size("tools_configured") > 0, F.lit(False)).alias("exists"), "tools_configured", "total_word_count", "total_constraint_count", "rules").alias("agent_configs"),
        F.struct("infrastructure.*").alias("infrastructure"),
        F.struct(F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"), "frameworks", "has_lockfile").alias("dependencies"),
        F.struct("version_commits", "active_days", n("total_commits", "active_days").alias("commits_per_active_day")).alias("git_workflow"),
        F.struct("total_lines_added", "total_lines_deleted", n("total_lines_deleted", "changed").alias("deletion_ratio"), n("refactors", "total_commits").alias("refactor_commit_ratio"), "net_loc_change").alias("code_evolution"),
        F.struct("performance.*").alias("performance"),
        F.struct(
            *[(F.col(f"production_paths.{k}") | F.coalesce(F.col(f"production.{k}"), F.lit(False))).alias(k) for k in ("has_error_tracking", "has_health_check", "has_rate_limiting")],
            F.coalesce("production.has_logging", F.lit(False)).alias("has_logging"), "production_paths.has_env_config",
        ).alias("production_readiness"),
    )
