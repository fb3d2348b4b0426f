"""Recipes: one JSON object per portal, read as one row per recipe and task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.dom import Selector
from tenderlake.schemas import RECIPE


def parse_recipes(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(recipe_id, body)`` rows to task rows, and the rejected recipes with a reason."""
    keyed = bodies.select("recipe_id", "body", F.json_object_keys("body").alias("keys"))
    accepted = F.coalesce(F.size("keys") > 0, F.lit(False))
    rejects = keyed.filter(~accepted).select(
        "recipe_id",
        F.when(F.col("keys").isNull(), "unparsable").otherwise("empty").alias("reason"),
    )
    tasks = (
        keyed.filter(accepted)
        .select("recipe_id", F.from_json("body", RECIPE).alias("r"))
        .select("recipe_id", "r.*")
        .select("*", F.posexplode_outer("routine").alias("task_idx", "task"))
        .select(
            "recipe_id",
            F.col("name").alias("recipe_name"),
            "baseURI",
            "charset",
            "delay",
            "randomizeDelay",
            "aspnet",
            "task_idx",
            F.col("task.id").alias("task_id"),
            F.col("task.name").alias("task_name"),
            F.coalesce("task.list", F.lit(False)).alias("is_list"),
            F.coalesce("task.pagination", F.lit(False)).alias("pagination"),
            F.col("task.request").alias("request"),
            F.transform_values("task.selectors", lambda _, v: _as_list(v)).alias("selectors"),
            F.col("task.patterns").alias("patterns"),
        )
    )
    return tasks, rejects


def _as_list(selector: Column) -> Column:
    """A selector given as text or as a JSON array of texts."""
    many = F.when(selector.startswith("["), F.from_json(selector, "array<string>"))
    return F.when(F.element_at(many, 1).isNotNull(), many).otherwise(F.array(selector))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """The text of all ``*.json`` recipes below ``path``, keyed by file stem."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    return files.select(stem.alias("recipe_id"), F.col("value").alias("body"))


def read_recipes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Task rows and rejects of all recipes below ``path``."""
    return parse_recipes(read_bodies(spark, path))


def find_recipe(bodies: DataFrame, recipe_id: str) -> DataFrame:
    """The text of one recipe, if it is a JSON object."""
    found = bodies.filter(F.col("recipe_id") == recipe_id)
    return found.filter(F.json_object_keys("body").isNotNull())


@dataclass(frozen=True)
class Task:
    id: str
    is_list: bool
    pagination: bool
    selectors: dict[str, tuple[Selector, ...]]
    patterns: dict[str, str]


@dataclass(frozen=True)
class Recipe:
    """A recipe compiled for the page scan."""

    recipe_id: str
    charset: str | None = None
    aspnet: bool = False
    tasks: tuple[Task, ...] = field(default=())
    base_uri: str | None = None
    delay: str | None = None

    def task(self, task_id: str) -> Task | None:
        return next((t for t in self.tasks if t.id == task_id), None)


_GROUPS: dict[str, int] = {}


def pattern_groups(spark: SparkSession, pattern: str) -> int:
    """Number of capture groups as the JVM counts them; 0 makes the whole match the result. Each different
    pattern is asked for once."""
    if pattern not in _GROUPS:
        _GROUPS[pattern] = spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    return _GROUPS[pattern]


def _unsupported_selectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad: dict[str, str] = {}
        for text in batch.column(0).to_pylist():
            try:
                Selector(text)
            except ValueError as error:
                bad[text] = str(error)
        yield pa.RecordBatch.from_pydict(
            {"text": pa.array(list(bad), pa.string()), "reason": pa.array(list(bad.values()), pa.string())}
        )


def check_recipes(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The task rows of recipes that can run, and the other recipes with a reason.

    A recipe with a selector or pattern that is not supported, or without any task, is rejected whole; its first
    fault is the reason. Different texts are checked once each, where they are: selectors by the page scan's own
    parser, patterns by the JVM's. No recipe passes through the driver.
    """
    keys = ["recipe_id", "task_idx"]
    given = tasks.filter(F.col("task_idx").isNotNull())
    selectors = given.select(*keys, F.explode("selectors").alias("name", "texts")).select(
        *keys, "name", F.explode("texts").alias("text")
    )
    foreign = selectors.select("text").distinct().filter("text IS NOT NULL").mapInArrow(
        _unsupported_selectors, "text string, reason string"
    )
    patterns = given.select(*keys, F.explode("patterns").alias("name", "text")).filter("text IS NOT NULL")
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("text"))
    broken = patterns.select("text").distinct().filter(compiled.isNull())
    why = F.concat(F.lit("pattern not supported in "), "recipe_id", F.lit(": "), "name")
    faults = (
        patterns.join(broken, "text").select(*keys, F.lit(0).alias("turn"), "name", why.alias("reason"))
        .union(selectors.join(foreign, "text").select(*keys, F.lit(1), "name", "reason"))
        .union(
            tasks.filter(F.col("task_idx").isNull()).select(*keys, F.lit(2), F.lit(""), F.lit("no tasks"))
        )
    )
    rejects = faults.groupBy("recipe_id").agg(F.min_by("reason", F.struct("task_idx", "turn", "name", "reason")).alias("reason"))
    return tasks.join(rejects.select("recipe_id"), "recipe_id", "left_anti"), rejects


def compile_recipes(tasks: DataFrame) -> tuple[list[Recipe], DataFrame]:
    """The recipes that can run, compiled for the page scan, and the rejected ones with a reason."""
    usable, rejects = check_recipes(tasks)
    recipes: dict[str, Recipe] = {}
    for row in usable.orderBy("recipe_id", "task_idx").toLocalIterator():
        known = recipes.get(row.recipe_id)
        recipes[row.recipe_id] = Recipe(
            row.recipe_id, row.charset, bool(row.aspnet), (known.tasks if known else ()) + (_compile(row),), row.baseURI, row.delay
        )
    return list(recipes.values()), rejects


def _compile(row) -> Task:
    selectors = {k: tuple(Selector(s) for s in v) for k, v in (row.selectors or {}).items()}
    patterns = {k: v for k, v in (row.patterns or {}).items() if v is not None}
    return Task(row.task_id, row.is_list, row.pagination, selectors, patterns)


def load_recipes(tasks: DataFrame) -> list[Recipe]:
    """All recipes, compiled; the first that is not supported raises."""
    recipes, rejects = compile_recipes(tasks)
    first = rejects.first()
    if first:
        raise ValueError(first.reason)
    return recipes
