"""A/B inputs: one JSON document per comparison, or one JSON line per output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT_KEYS = ("text", "generated")


def _text_of(output: Column) -> Column:
    """The text of an output that is a plain string or an object.

    The first key that is there wins, even when it holds null.
    """
    kind = F.schema_of_variant(output)

    def key(name: str) -> Column:
        return F.try_variant_get(output, f"$.{name}", "string")

    def has(name: str) -> Column:
        return F.try_variant_get(output, f"$.{name}", "variant").isNotNull()

    return (
        F.when(kind == "STRING", F.try_variant_get(output, "$", "string"))
        .when(has("text"), key("text"))
        .when(has("generated"), key("generated"))
        .otherwise("")
    )


def _metadata_of(output: Column) -> Column:
    """The other keys of an output object, each as JSON text."""
    fields = F.from_json(F.to_json(output), "map<string,string>")
    return F.when(
        F.schema_of_variant(output).startswith("OBJECT"),
        F.map_filter(fields, lambda k, _: ~k.isin(*_TEXT_KEYS)),
    ).otherwise(F.create_map().cast("map<string,string>"))


def _list(path: str, item: str) -> Column:
    """A list of a document; null when it is missing or no list of such items."""
    return F.try_variant_get("_doc", path, f"array<{item}>")


def _outputs(slot: str) -> Column:
    return _list(f"$.model_{slot}.outputs", "variant")


def _is_output(output: Column) -> Column:
    kind = F.schema_of_variant(output)
    return (kind == "STRING") | kind.startswith("OBJECT")


def _reason(json_column: str) -> Column:
    """Why a document cannot be compared, or null: the first fault that applies."""

    def no_list(name: str) -> Column:
        there = F.try_variant_get("_doc", f"$.{name}", "variant").isNotNull()
        return F.when(there & _list(f"$.{name}", "string").isNull(), F.lit(f"{name} is no list"))

    outputs = {slot: F.col(f"_lists.{slot}") for slot in ("a", "b")}

    def side(slot: str) -> Column:
        bad = F.filter(outputs[slot], lambda o: ~F.coalesce(_is_output(o), F.lit(False)))
        return F.when(outputs[slot].isNull(), F.lit(f"model_{slot} has no list of outputs")).when(
            F.size(bad) > 0,
            F.concat(F.lit(f"model_{slot} has outputs that are neither text nor object: "), F.size(bad).cast("string")),
        )

    sizes = [F.size(outputs[slot]) for slot in ("a", "b")]
    return F.coalesce(
        F.when(F.col(f"`{json_column}`").isNull(), F.lit("no document")),
        F.when(F.col("_doc").isNull(), F.lit("not valid JSON")),
        F.when(~F.schema_of_variant("_doc").startswith("OBJECT"), F.lit("not an object")),
        side("a"), side("b"), no_list("prompts"), no_list("sources"),
        F.when(
            sizes[0] != sizes[1],
            F.concat(F.lit("unequal outputs: "), sizes[0].cast("string"), F.lit(" and "), sizes[1].cast("string")),
        ),
    )


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is made once a row: filters on it are not pushed down as copies of what makes it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _parsed(df: DataFrame, json_column: str) -> DataFrame:
    return _with(df, "_doc", F.try_parse_json(F.col(f"`{json_column}`")))


def checked_ab(df: DataFrame, json_column: str = "value") -> DataFrame:
    """A/B documents with ``_doc``, the parsed document, and ``reason``, why it cannot be compared.

    A document that is not valid JSON fails alone, not the job.
    """
    lists = F.struct(*[_outputs(slot).alias(slot) for slot in ("a", "b")])
    listed = _with(_parsed(df, json_column), "_lists", lists)
    return _with(listed, "reason", _reason(json_column)).drop("_lists")


def quarantined_ab(df: DataFrame, json_column: str = "value") -> DataFrame:
    """The documents that cannot be compared, as they came, with ``reason``."""
    return checked_ab(df, json_column).where("reason is not null").drop("_doc")


def parse_ab(df: DataFrame, json_column: str = "value", comparable: bool = False) -> DataFrame:
    """One row per output of each A/B document.

    Adds slot ('a' or 'b'), sample_index, model_id, generated, prompt, source, metadata.
    Prompts and sources go by position; a position past the end of the list gives "". With
    ``comparable`` the documents of :func:`quarantined_ab` are left out whole; without, a document
    gives the outputs it has, even if its sides differ in number.
    """
    doc = checked_ab(df, json_column).where("reason is null") if comparable else _parsed(df, json_column)

    def at(values: str, i: Column) -> Column:
        return F.coalesce(F.get(F.col(values), i), F.lit(""))

    def side(slot: str) -> Column:
        key = f"model_{slot}"
        # every output carries its own prompt and source, so the lists are not repeated per row
        items = F.transform(
            _outputs(slot),
            lambda o, i: F.struct(
                o.alias("output"), at("_prompts", i).alias("prompt"), at("_sources", i).alias("source")
            ),
        )
        return F.struct(
            F.lit(slot).alias("slot"),
            F.coalesce(F.try_variant_get("_doc", f"$.{key}.id", "string"), F.lit(key)).alias("model_id"),
            items.alias("items"),
        )

    kept = [F.col(f"`{c}`") for c in df.columns if c != json_column]
    lists = doc.withColumns({"_prompts": _list("$.prompts", "string"), "_sources": _list("$.sources", "string")})
    sides = lists.select(*kept, F.inline(F.array(side("a"), side("b"))))
    outputs = sides.select(*kept, "slot", "model_id", F.posexplode("items").alias("sample_index", "_item"))
    return outputs.select(
        *kept,
        "slot",
        "sample_index",
        "model_id",
        _text_of(F.col("_item.output")).alias("generated"),
        F.col("_item.prompt").alias("prompt"),
        F.col("_item.source").alias("source"),
        _metadata_of(F.col("_item.output")).alias("metadata"),
    )


def read_ab_json(spark: SparkSession, path: str) -> DataFrame:
    """A/B documents, one per file. A document is read by one task; many files spread."""
    files = spark.read.text(path, wholetext=True)
    return parse_ab(files.withColumn("suite_id", F.input_file_name()))


LINE_SCHEMA = (
    "suite_id string, slot string, sample_index int, model_id string, output variant"
)


def read_ab_lines(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """The long form, for comparisons too large for one document.

    ``outputs`` has LINE_SCHEMA; ``inputs`` has suite_id, sample_index, prompt, source. Both
    can be read from splittable JSON lines. They meet on a key that is unique per input.
    """
    joined = outputs.join(inputs, ["suite_id", "sample_index"], "left")
    return joined.select(
        "suite_id",
        "slot",
        "sample_index",
        F.coalesce("model_id", F.concat(F.lit("model_"), F.col("slot"))).alias("model_id"),
        _text_of(F.col("output")).alias("generated"),
        F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.coalesce("source", F.lit("")).alias("source"),
        _metadata_of(F.col("output")).alias("metadata"),
    )
