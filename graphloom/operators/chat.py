"""Chat requests: normalisation of JSON payloads as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import present, strip

ROLES = ("system", "user", "assistant")
PROVIDER, MODEL = "hf", "BAAI/bge-m3"
#: Retriever names as requests give them, and the names here.
RETRIEVERS = {"one-hop": "one-hop", "graph-hop": "one-hop", "graph-2-hop": "one-hop", "graph": "one-hop", "vector": "vector", "collect": "collect", "fastinsight": "collect", "fi": "collect", "hybrid": "hybrid"}


def retriever_name(name: Column, default: str = "one-hop") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RETRIEVERS.items() for x in kv])[F.lower(strip(name))], F.lit(default))


def policy(value: Column, default: Column) -> Column:
    v = F.lower(strip(value))
    return F.when(v.isin("fallback", "soft"), "fallback").when(v.isin("error", "fail", "strict", "raise"), "raise").otherwise(default)


def requests(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with the fields of its JSON column; ``valid`` is false without a message."""
    field = lambda *names: F.coalesce(*[F.get_json_object(column, f"$.{n}") for n in names])
    raise_ = F.lit("raise")
    spec = field("embedding")
    is_object = spec.startswith("{")
    is_pair = ~is_object & F.contains(spec, F.lit(":"))
    inner = lambda key: F.when(is_object, F.get_json_object(spec, f"$.{key}"))
    provider = F.coalesce(F.when(is_pair, present(strip(F.substring_index(spec, ":", 1)))), inner("provider"), F.when(~is_object & ~is_pair, present(strip(spec))), field("embedding_provider", "embedder"))
    model = F.coalesce(F.when(is_pair, present(strip(F.expr("substring(_spec, instr(_spec, ':') + 1)")))), inner("model"), field("embedding_model"))
    history = F.from_json(field("history"), "array<struct<role:string,content:string,text:string>>")
    role = lambda m: F.when(F.lower(strip(m["role"])).isin(*ROLES), F.lower(strip(m["role"]))).otherwise("user")
    kept = F.filter(F.transform(history, lambda m: F.struct(role(m).alias("role"), strip(F.coalesce(m["content"], m["text"], F.lit(""))).alias("content"))), lambda m: m["content"] != "")
    message = strip(F.coalesce(field("message", "query"), F.lit("")))
    number = field("top_k").try_cast("int")
    return payloads.withColumn("_spec", spec).select(
        *payloads.columns,
        message.alias("message"),
        (message != "").alias("valid"),
        F.coalesce(kept, F.array().cast("array<struct<role:string,content:string>>")).alias("history"),
        F.coalesce(field("graph"), F.lit("default")).alias("graph"),
        F.coalesce(field("model"), F.lit("gpt-5-nano")).alias("model"),
        F.coalesce(field("retrieval"), F.lit("one-hop")).alias("retrieval"),
        F.coalesce(present(F.lower(strip(provider))), F.lit(PROVIDER)).alias("embedding_provider"),
        F.coalesce(present(strip(model)), F.lit(MODEL)).alias("embedding_model"),
        policy(inner("error_policy"), policy(field("embedding_error_policy"), raise_)).alias("embedding_error_policy"),
        F.greatest(F.lit(1), F.coalesce(number, F.lit(5))).alias("top_k"),
        F.coalesce(field("index_name"), F.lit("node_vector")).alias("index_name"),
        present(strip(field("session_id"))).alias("session_id"),
    )


def first_field(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the named fields with text, else the first value with text, of a JSON object."""
    named = [present(strip(F.get_json_object(record, f"$.{n}"))) for n in names]
    any_value = F.get(F.filter(F.map_values(F.from_json(record, "map<string,string>")), lambda v: strip(v) != ""), F.lit(0))
    return F.coalesce(*named, strip(any_value))
