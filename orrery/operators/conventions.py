"""Conventions of a code base, found in its imports, paths and classes: which libraries it uses for what, how it tests.

Each scanner counts the files behind a finding and asks for two at least; all findings become seed cards of one shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.scanners import LEAST, TEST_PATHS, best_library, error_families, largest_family, seed_id

# Libraries by purpose, in order of precedence, with the modules that name them.
FRAMEWORKS = (
    ("Express", "express"), ("Fastify", "fastify"), ("Koa", "koa"), ("Hono", "hono"), ("FastAPI", "fastapi"), ("Flask", "flask"), ("Django", "django.urls"), ("Django", "django"),
    ("Gin", "github.com/gin-gonic/gin"), ("Chi", "github.com/go-chi/chi"), ("Axum", "axum"), ("Actix Web", "actix_web"), ("Actix Web", "actix-web"),
)
LOGGERS = (
    ("winston", "winston"), ("pino", "pino"), ("bunyan", "bunyan"), ("log4js", "log4js"), ("loglevel", "loglevel"), ("consola", "consola"),
    ("logging (stdlib)", "logging"), ("loguru", "loguru"), ("structlog", "structlog"),
    ("log/slog (stdlib)", "log/slog"), ("logrus", "github.com/sirupsen/logrus"), ("zap", "go.uber.org/zap"), ("zerolog", "github.com/rs/zerolog"),
    ("tracing", "tracing"), ("log", "log"), ("slog", "slog"),
)
CONFIGURATION = (
    ("dotenv", "dotenv"), ("envalid", "envalid"), ("@t3-oss/env-nextjs", "@t3-oss/env-nextjs"), ("@t3-oss/env-nextjs", "@t3-oss/env-core"), ("znv", "znv"), ("convict", "convict"), ("node-config", "config"),
    ("pydantic-settings", "pydantic_settings"), ("python-decouple", "decouple"), ("dynaconf", "dynaconf"),
    ("viper", "github.com/spf13/viper"), ("envconfig", "github.com/kelseyhightower/envconfig"), ("godotenv", "github.com/joho/godotenv"),
    ("config", "config"), ("envy", "envy"), ("figment", "figment"),
)
PERSISTENCE = (
    ("Prisma", "@prisma/client"), ("Prisma", "prisma"), ("Drizzle", "drizzle-orm"), ("TypeORM", "typeorm"), ("Sequelize", "sequelize"), ("Mongoose", "mongoose"), ("Kysely", "kysely"),
    ("better-sqlite3", "better-sqlite3"), ("node-postgres (pg)", "pg"), ("mysql2", "mysql2"), ("mysql2", "mysql2/promise"),
    ("SQLAlchemy", "sqlalchemy"), ("Django ORM", "django.db"), ("Tortoise ORM", "tortoise"),
    ("gorm", "gorm.io/gorm"), ("sqlx (Go)", "github.com/jmoiron/sqlx"), ("ent", "entgo.io/ent"),
    ("sqlx", "sqlx"), ("Diesel", "diesel"), ("SeaORM", "sea_orm"), ("SeaORM", "sea-orm"),
)
TEST_FRAMEWORKS = (
    ("Vitest", "vitest"), ("Jest", "jest"), ("Jest", "@jest/globals"), ("Mocha", "mocha"), ("Jasmine", "jasmine"), ("Playwright", "@playwright/test"), ("Playwright", "playwright"),
    ("Cypress", "cypress"), ("pytest", "pytest"), ("unittest", "unittest"),
)
#: The module of a project's own configuration, and the name of that convention.
OWN_CONFIG, OWN_CONFIG_NAME = r"(?i)(^|[./])config(\.[a-z]+)?$", "project-local config module"
GO_TEST_FILE, GO_TESTS = r"(^|/)[^/]+_test\.go$", "Go test"

#: Files that a card shows.
SAMPLES = 5
#: Slug and name of the card of every scanner, in the order of the cards.
CARDS = {
    "errors": "Error / exception convention", "tests": "Test convention", "logging": "Logging convention", "config-env": "Configuration / environment convention",
    "persistence": "Persistence / transaction convention", "framework": "HTTP handler convention",
}


def names_module(module: Column, needle: Column) -> Column:
    """Whether a module is the needle or something below it, by slash or by dot."""
    return (module == needle) | module.startswith(F.concat(needle, F.lit("/"))) | module.startswith(F.concat(needle, F.lit(".")))


def _table(df: DataFrame, libraries: tuple[tuple[str, str], ...]) -> DataFrame:
    """Position, library and needle; a library named twice has the position of its first needle."""
    order = {name: i for i, name in reversed(list(enumerate(name for name, _ in libraries)))}
    rows = [(i, order[name], name, needle) for i, (name, needle) in enumerate(libraries)]
    return df.sparkSession.createDataFrame(rows, "place int, position int, library string, needle string")


def import_sites(edges: DataFrame) -> DataFrame:
    """``file, module`` of parsed edges ``from_id, to_name, to_path, kind``: the path, else the name, without quotes."""
    module = F.trim(F.coalesce(F.when(F.trim("to_path") != "", F.col("to_path")), F.col("to_name")))
    rows = edges.filter("kind = 'imports' and from_id is not null").select(F.split("from_id", "::")[0].alias("file"), F.regexp_replace(module, r"""^(["'])(.*)\1$""", "$2").alias("module"))
    return rows.filter("module != ''").distinct()


def users(sites: DataFrame, libraries: tuple[tuple[str, str], ...]) -> DataFrame:
    """``file, library, position``: every site counts for the first library whose module it names.

    The list of libraries is the program's own, tens of rows, and broadcast; modules are matched once each.
    """
    modules = sites.select("module").distinct()
    hits = modules.join(F.broadcast(_table(sites, libraries)), names_module(F.col("module"), F.col("needle")))
    first = hits.groupBy("module").agg(F.min_by(F.struct("library", "position"), "place").alias("x")).select("module", "x.*")
    return sites.join(first, "module").select("file", "library", "position").distinct()


def _best(found: DataFrame) -> DataFrame:
    """``library, files``: the library most files use, the earlier one on ties."""
    return best_library(found.select("file", "library"), found.select("library", "position").distinct())


def config_users(sites: DataFrame) -> DataFrame:
    """As ``users`` for configuration; modules that name no library but end in ``config`` are the project's own."""
    known = users(sites, CONFIGURATION)
    rest = sites.filter(~_any_needle("module", CONFIGURATION) & F.col("module").contains("/") & F.col("module").rlike(OWN_CONFIG))
    return known.unionByName(rest.select("file", F.lit(OWN_CONFIG_NAME).alias("library"), F.lit(len(CONFIGURATION)).alias("position")).distinct())


def _any_needle(module: str, libraries: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(False)
    for _, needle in libraries:
        out = out | names_module(F.col(module), F.lit(needle))
    return out


def test_framework(files: DataFrame, sites: DataFrame) -> DataFrame:
    """``library, files``: the test framework most test files import; ``Go test`` where none is imported and all test files
    are Go's, null where nothing tells. One row, none with fewer than two test files.

    ``files``: distinct ``file`` that are tests.
    """
    found = users(sites.join(files, "file", "left_semi"), TEST_FRAMEWORKS)
    counts = found.groupBy("library").agg(F.countDistinct("file").alias("n"), F.min("position").alias("position"))
    best = counts.agg(F.min_by("library", F.struct((-F.col("n")).alias("k"), "position")).alias("imported"))
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.every(F.col("file").rlike(GO_TEST_FILE)), F.lit(False)).alias("go"))
    # Both sides are one row.
    both = total.join(F.broadcast(best), F.lit(True), "left").filter(F.col("files") >= LEAST)
    return both.select(F.coalesce("imported", F.when(F.col("go"), F.lit(GO_TESTS))).alias("library"), "files")


def test_files(paths: DataFrame) -> DataFrame:
    """The distinct test files of ``file``."""
    return paths.filter(F.col("file").rlike(TEST_PATHS)).select("file").distinct()


def library_conventions(sites: DataFrame) -> DataFrame:
    """``scanner, library, files`` of the scanners that look at imports: one winner each, but every framework in use."""
    parts = [
        _best(users(sites, LOGGERS)).withColumn("scanner", F.lit("logging")),
        _best(config_users(sites)).withColumn("scanner", F.lit("config-env")),
        _best(users(sites, PERSISTENCE)).withColumn("scanner", F.lit("persistence")),
        users(sites, FRAMEWORKS).groupBy("library").agg(F.countDistinct("file").alias("files")).filter(F.col("files") >= LEAST).withColumn("scanner", F.lit("framework")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("scanner", "library", "files")


def seed_skills(sites: DataFrame, paths: DataFrame, inheritance: DataFrame) -> DataFrame:
    """All findings as seed cards: ``id, slug, name, library, evidence_count, sample_paths, maturity, confidence, observed_days``.

    ``sites``: ``file, module``; ``paths``: ``file``; ``inheritance``: ``class_id, base_name``. A card's id depends on its
    scanner, library and files: on their number and on a sum of their hashes, so that files are never gathered. The first
    ``SAMPLES`` paths are shown; the limit of a rank applies before the shuffle.
    """
    tests = test_files(paths.select("file").unionByName(sites.select("file")))
    evidence = [
        users(sites, LOGGERS).select(F.lit("logging").alias("scanner"), "library", "file"),
        config_users(sites).select(F.lit("config-env").alias("scanner"), "library", "file"),
        users(sites, PERSISTENCE).select(F.lit("persistence").alias("scanner"), "library", "file"),
        users(sites, FRAMEWORKS).select(F.lit("framework").alias("scanner"), "library", "file"),
    ]
    families = error_families(inheritance)
    errors = families.select(F.lit("errors").alias("scanner"), F.col("root").alias("library"), F.split("class_id", "::")[0].alias("file"))
    # Classes count as evidence for errors, files for the rest.
    error_wins = largest_family(families).select(F.lit("errors").alias("scanner"), F.col("root").alias("library"), F.col("members").alias("files"))
    test_wins = test_framework(tests, sites).select(F.lit("tests").alias("scanner"), F.coalesce("library", F.lit("unknown")).alias("library"), "files")
    wins = library_conventions(sites).unionByName(error_wins).unionByName(test_wins)
    shown = evidence[0]
    for e in [*evidence[1:], errors.distinct()]:
        shown = shown.unionByName(e)
    shown = shown.join(wins.select("scanner", "library"), ["scanner", "library"])
    test_library = test_wins.select("scanner", "library")
    shown = shown.unionByName(tests.withColumn("scanner", F.lit("tests")).join(test_library, "scanner").select("scanner", "library", "file"))
    digest = shown.groupBy("scanner", "library").agg(F.sum(F.xxhash64("file").cast("decimal(38,0)")).cast("string").alias("digest"))
    rank = Window.partitionBy("scanner", "library").orderBy("file")
    first = shown.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= SAMPLES)
    samples = first.groupBy("scanner", "library").agg(F.array_sort(F.collect_list("file")).alias("sample_paths"))
    rows = wins.join(digest, ["scanner", "library"]).join(samples, ["scanner", "library"])
    slug = F.when(F.col("scanner") == "framework", F.concat(F.lit("framework-"), F.lower(F.regexp_replace(F.regexp_replace("library", " Web$", ""), r"\s+", "-")))).otherwise(F.col("scanner"))
    titles = F.create_map(*[F.lit(x) for pair in CARDS.items() for x in pair])
    return rows.select(
        seed_id("convention", F.array("scanner", "library", F.col("files").cast("string"), "digest")).alias("id"), slug.alias("slug"), titles[F.col("scanner")].alias("name"), "library",
        F.col("files").alias("evidence_count"), "sample_paths", F.lit("deterministic_seed").alias("maturity"), F.lit(1.0).alias("confidence"), F.lit(0).alias("observed_days"),
    )
