"""Task lists, task configurations and their inheritance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import durable
from scorelake.sources.logs import logical_path


def read_task_list(spark: SparkSession, path: str) -> DataFrame:
    """(task, n) of JSON objects that map a task name to its number of samples."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.explode(F.from_json("value", "map<string,bigint>", {"mode": "FAILFAST"})).alias("task", "n")
    )


def read_task_status(spark: SparkSession, path: str) -> DataFrame:
    """(model, task, done) of JSON objects model -> task -> true."""
    raw = spark.read.text(path, wholetext=True)
    models = raw.select(
        F.explode(F.from_json("value", "map<string,map<string,boolean>>", {"mode": "FAILFAST"})).alias("model", "tasks")
    )
    return models.select("model", F.explode("tasks").alias("task", "done"))


def read_config_names(spark: SparkSession, path: str) -> DataFrame:
    """First column of a CSV file without empty rows."""
    rows = spark.read.option("header", "false").csv(path)
    return rows.select(F.trim(F.col(rows.columns[0])).alias("config")).filter(
        F.col("config").isNotNull() & (F.col("config") != "")
    )


ENTRY_SCHEMA = "path string, item string, value string, include array<string>"


def read_task_configs(spark: SparkSession, root: str, files: str = "*.yaml") -> DataFrame:
    """Top-level entries of every YAML file below a folder: one row per (file, key), values as JSON text, with the
    files it includes as full paths.

    Included files are read whatever their name ends with and wherever they lie; one that is not there stops the
    job. The decoded entries are stored, so that no later step decodes the files again.
    """
    below = (
        spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
        .select("value", logical_path(F.col("_metadata.file_path")).alias("path"))
        .filter(~F.col("path").rlike("/(__pycache__|\\.ipynb_checkpoints)/"))
    )
    suffix = files.removeprefix("*")
    entries = durable(below.filter(F.col("path").endswith(suffix if suffix.startswith(".") else ".yaml")).mapInPandas(_decode_yaml, ENTRY_SCHEMA))
    while True:
        known = entries.select("path").distinct()
        targets = entries.select(F.explode("include").alias("path")).distinct().join(known, "path", "left_anti")
        more = durable(below.join(targets, "path").select("value", "path").mapInPandas(_decode_yaml, ENTRY_SCHEMA))
        # As many paths as there are configuration files at most.
        outside = [r.path for r in targets.join(more.select("path").distinct(), "path", "left_anti").collect()]
        if outside:
            texts = spark.read.text(outside, wholetext=True).select("value", logical_path(F.col("_metadata.file_path")).alias("path"))
            more = durable(more.unionByName(texts.mapInPandas(_decode_yaml, ENTRY_SCHEMA)))
        if more.isEmpty():
            return entries
        entries = durable(entries.unionByName(more))


def _decode_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json
    import posixpath

    import yaml

    class Loader(yaml.SafeLoader):
        """Reads ``!function`` and other tags as plain text instead of importing anything."""

    Loader.add_multi_constructor("!", lambda loader, _suffix, node: loader.construct_scalar(node))
    names = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for text, path in zip(batch["value"], batch["path"]):
            config = yaml.load(text, Loader=Loader)
            config = config if isinstance(config, dict) else {}
            include = config.pop("include", [])
            include = [include] if isinstance(include, str) else list(include)
            directory = path.rpartition("/")[0]
            full = [posixpath.normpath(f"file:{n}" if n.startswith("/") else f"{directory}/{n}") for n in include]
            for key, value in [*config.items(), (None, None)]:
                shown = None if key is None else json.dumps(value, ensure_ascii=False, default=str)
                rows.append((path, key, shown, full))
        yield pd.DataFrame(rows, columns=names)


def resolved_configs(entries: DataFrame) -> DataFrame:
    """(path, item, value) with included files folded in: own entries win, then those of the include
    named first. Includes are followed level by level until there are none; each level is one equality join on the
    file. A file that includes itself, over any number of steps, stops the job."""
    own = entries.filter(F.col("item").isNotNull()).select("path", "item", "value")
    step = (
        entries.select("path", "include").distinct()
        .select(F.col("path").alias("_from"), F.posexplode("include").alias("place", "_to"))
    )
    # Rank of an inherited entry: the places of the includes on the way down. Arrays compare entry by
    # entry and a shorter one first, so an entry of a nearer file always ranks before a farther one.
    levels = frontier = entries.select("path").distinct().select(
        F.col("path"), F.col("path").alias("target"), F.expr("array(cast(0 as int))").alias("rank")
    )
    while True:
        frontier = durable(frontier.join(step, frontier["target"] == step["_from"]).select(
            "path", F.col("_to").alias("target"), F.concat("rank", F.array(F.col("place") + 1)).alias("rank")
        ))
        state = frontier.agg(F.count("*"), F.bool_or(F.col("path") == F.col("target"))).first()
        if state[1]:
            raise ValueError("a configuration file includes itself")
        if not state[0]:
            break
        levels = levels.unionByName(frontier)
    inherited = levels.join(own.withColumnRenamed("path", "target"), "target")
    return inherited.groupBy("path", "item").agg(F.min_by("value", "rank").alias("value"))


def task_catalog(configs: DataFrame) -> DataFrame:
    """One row per named task, group or tag-bearing task: (name, kind, path, output_type, tags)."""
    def item(name: str):
        return F.max(F.when(F.col("item") == name, F.col("value"))).alias(name)

    wide = configs.groupBy("path").agg(*[item(n) for n in ("task", "group", "class", "tag", "output_type")])
    text = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    listed = F.col("task").startswith("[")
    kind = (
        F.when(F.col("class").isNotNull() & F.col("task").isNotNull(), "python_task")
        .when(F.col("group").isNotNull() & listed, "group")
        .when(F.col("task").isNotNull() & ~listed, "task")
    )

    def names(column: str):
        """A list of names, or the one name a text is, commas and all."""
        one = F.array(text(F.col(column)))
        listed_names = F.when(F.col(column).startswith("["), F.from_json(column, "array<string>")).otherwise(one)
        return F.when(F.col(column).isNotNull(), listed_names).otherwise(F.array().cast("array<string>"))

    # The group key of a task is a tag under another name.
    tags = F.when(F.col("kind") == "task", F.concat(names("tag"), names("group"))).otherwise(names("tag"))
    return wide.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        F.when(F.col("kind") == "group", text(F.col("group"))).otherwise(text(F.col("task"))).alias("name"),
        "kind", "path", F.coalesce(text(F.col("output_type")), F.lit("")).alias("output_type"), tags.alias("tags"),
    )


def tag_index(catalog: DataFrame) -> DataFrame:
    """(tag, task) for every tag of every task; a tag named like a group stays out."""
    groups = catalog.filter(F.col("kind") == "group").select(F.col("name").alias("tag"))
    tagged = catalog.filter(F.col("kind") == "task").select(F.explode("tags").alias("tag"), F.col("name").alias("task"))
    return tagged.filter(F.col("tag") != "").join(groups, "tag", "left_anti")


def sorted_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.select("kind", "name", "path", "output_type").orderBy("kind", "name")


def group_members(configs: DataFrame) -> DataFrame:
    """(parent, child) edges of group files. An entry written out in place is the task or group it names; the second
    such task of one name in a group is told apart by a number. Groups written out in groups give edges of their own."""
    def item(name: str):
        return F.max(F.when(F.col("item") == name, F.col("value"))).alias(name)

    wide = configs.groupBy("path").agg(item("group"), item("task")).filter(
        F.col("group").isNotNull() & F.col("task").startswith("[")
    )
    level = wide.select(F.get_json_object(F.concat(F.lit('{"v":'), "group", F.lit("}")), "$.v").alias("parent"), "task")
    edges = None
    while True:
        entries = F.from_json("task", "array<string>")
        level = durable(level.select("parent", _named_children(entries).alias("children")).select("parent", F.explode("children").alias("c")))
        found = level.select("parent", F.col("c.name").alias("child"))
        edges = found if edges is None else edges.unionByName(found)
        inner = level.filter(F.col("c.inner").isNotNull()).select(F.col("c.name").alias("parent"), F.col("c.inner").alias("task"))
        if inner.isEmpty():
            return edges
        level = inner


def _named_children(entries):
    """(name, inner) of the entries of a group: inner is the list of a group written out in place."""
    start = F.array().cast("array<struct<name:string,inner:string,plain:boolean>>")

    def add(done, entry):
        inline = entry.startswith("{")
        group = F.get_json_object(entry, "$.group")
        inner = F.when(inline & group.isNotNull(), F.get_json_object(entry, "$.task"))
        name = F.when(inline, F.coalesce(group, F.get_json_object(entry, "$.task"))).otherwise(entry)
        same = F.size(F.filter(done, lambda d: ~d["plain"] & d["name"].startswith(name)))
        numbered = F.when(inline & group.isNull() & (same > 0), F.concat(name, F.lit("-"), same.cast("string"))).otherwise(name)
        return F.concat(done, F.array(F.struct(numbered.alias("name"), inner.alias("inner"), (~inline).alias("plain"))))

    return F.aggregate(entries, start, add)


def duplicate_names(catalog: DataFrame) -> DataFrame:
    """Names defined by more than one file."""
    counts = catalog.groupBy("name").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))
    return counts.filter(F.col("files") > 1)
