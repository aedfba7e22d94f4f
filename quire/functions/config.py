"""JSON settings read by a schema: nested fields with types and defaults, and what can't be read named.

A schema is a dict of field -> (type, default), or of field -> dict for a nested object. Types are those
of DDL: string, int, double, boolean, arrays and maps of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.values import bound

# Names, types and defaults of the settings of the layout stage's pictures and of both models' files.
PREPROCESSOR = {
    "do_resize": ("boolean", True),
    "size": {"height": ("int", None), "width": ("int", None), "shortest_edge": ("int", None), "longest_edge": ("int", None)},
    "do_rescale": ("boolean", True),
    "rescale_factor": ("double", 1 / 255),
    "do_normalize": ("boolean", True),
    "image_mean": ("array<double>", [0.5, 0.5, 0.5]),
    "image_std": ("array<double>", [0.5, 0.5, 0.5]),
    "resample": ("int", None),
}
LAYOUT = {"model_type": ("string", None), "num_labels": ("int", None), "label2id": ("map<string, int>", None), "id2label": ("map<string, string>", None)}
_TOKENS = ("image_start_token_id", "image_end_token_id", "image_token_id", "video_start_token_id", "video_end_token_id", "video_token_id")
RECOGNISER = {
    "architectures": ("array<string>", None),
    "model_type": ("string", None),
    "transformers_version": ("string", None),
    "text_config": {
        "vocab_size": ("int", None), "hidden_size": ("int", None), "head_dim": ("int", None), "num_attention_heads": ("int", None), "num_hidden_layers": ("int", None), "num_key_value_heads": ("int", None), "intermediate_size": ("int", None),
        "eos_token_id": ("array<int>", None), "rms_norm_eps": ("double", None), "rope_parameters": {"rope_type": ("string", None), "mrope_section": ("array<int>", None), "partial_rotary_factor": ("double", None), "rope_theta": ("double", None)},
    },
    "vision_config": {"hidden_size": ("int", None), "depth": ("int", None), "num_heads": ("int", None), "image_size": ("int", None), "patch_size": ("int", None), "temporal_patch_size": ("int", None), "spatial_merge_size": ("int", None), "out_hidden_size": ("int", None)},
    **{t: ("int", None) for t in _TOKENS},
}


def ddl(schema: dict) -> str:
    """The schema as DDL of a struct's fields."""
    return ", ".join(f"`{k}`: struct<{ddl(v)}>" if isinstance(v, dict) else f"`{k}`: {v[0]}" for k, v in schema.items())


def _leaves(schema: dict, at: tuple[str, ...] = ()):
    for k, v in schema.items():
        yield ((*at, k), v)
        if isinstance(v, dict):
            yield from _leaves(v, (*at, k))


def _kinds(kind: str | None) -> list[str]:
    """How JSON values that fit a type begin, as a variant's schema is written."""
    if kind is None or kind.startswith("map"):
        return ["OBJECT"]
    return {"string": ["STRING"], "int": ["BIGINT"], "double": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}.get(kind, ["ARRAY"])


def read_config(text: Column, schema: dict) -> Column:
    """struct(config, problem): the settings with defaults where a field is missing or null, and the first fault.

    Faults: text that isn't a JSON object, and a field whose value isn't of its type (in the schema's
    order, with its path); config is then null. Fields that the schema doesn't name are ignored.
    """

    def build(p: Column, at: Column, fields: dict) -> list[Column]:
        out = []
        for k, v in fields.items():
            if isinstance(v, dict):
                out.append(F.struct(*build(p, at[k], v)).alias(k))
            else:
                default = F.lit(v[1]) if not isinstance(v[1], list) else F.array(*[F.lit(x) for x in v[1]])
                out.append((F.coalesce(at[k], default) if v[1] is not None else at[k]).alias(k))
        return out

    def read(both: Column) -> Column:
        raw, parsed = both["raw"], both["parsed"]
        faults = []
        for path, v in _leaves(schema):
            here = F.try_variant_get(raw, "$." + ".".join(path), "variant")
            kind = F.schema_of_variant(here)
            fits = F.lit(False)
            for k in _kinds(None if isinstance(v, dict) else v[0]):
                fits = fits | F.startswith(kind, F.lit(k))
            value = parsed
            for k in path:
                value = value[k]
            faults.append(F.when(here.isNotNull() & (kind != "VOID") & (~fits | value.isNull()), F.lit(".".join(path))))
        bad = F.coalesce(*faults)
        whole = F.startswith(F.schema_of_variant(raw), F.lit("OBJECT"))
        problem = F.when(~F.coalesce(whole, F.lit(False)), "not a JSON object").when(bad.isNotNull(), F.concat(F.lit("bad field "), bad))
        config = F.struct(*build(parsed, parsed, schema))
        return F.struct(F.when(problem.isNull(), config).alias("config"), problem.alias("problem"))

    return bound(F.struct(F.try_parse_json(text).alias("raw"), F.from_json(text, f"struct<{ddl(schema)}>").alias("parsed")), read)


def class_labels(id2label: Column) -> Column:
    """struct(labels map<int, string>, problem): JSON keys as whole numbers; a key that isn't one is a problem, as is a missing map."""
    keys = F.map_keys(id2label)
    odd = F.get(F.array_sort(F.filter(keys, lambda k: ~F.regexp_like(k, F.lit(r"^[+-]?[0-9]+$")) | k.try_cast("int").isNull())), F.lit(0))
    problem = F.when(id2label.isNull(), "missing id2label").when(odd.isNotNull(), F.concat(F.lit("invalid id2label key: "), odd))
    labels = F.map_from_entries(F.transform(F.map_entries(id2label), lambda e: F.struct(e["key"].try_cast("int").alias("key"), e["value"].alias("value"))))
    return F.struct(F.when(problem.isNull(), labels).alias("labels"), problem.alias("problem"))


def mean_and_std(config: Column) -> Column:
    """struct(mean, std) of three channels; the default of both unless both have three."""
    fine = (F.size(config["image_mean"]) == 3) & (F.size(config["image_std"]) == 3)
    half = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    return F.struct(F.when(fine, config["image_mean"]).otherwise(half).alias("mean"), F.when(fine, config["image_std"]).otherwise(half).alias("std"))


def resized(config: Column, width: Column, height: Column) -> Column:
    """struct(w, h) that a picture is resized to: fixed, or by its shorter edge within the longer one's bound; null if it isn't resized."""
    size = config["size"]
    near = lambda v: F.floor(v + 0.5)
    w, h = F.greatest(width, F.lit(1)).cast("double"), F.greatest(height, F.lit(1)).cast("double")
    scale = size["shortest_edge"].cast("double") / F.least(w, h)

    def bounded(s: Column) -> Column:
        over = (size["longest_edge"] > 0) & (F.greatest(s["w"], s["h"]) > size["longest_edge"])
        far = size["longest_edge"].cast("double") / F.greatest(s["w"], s["h"])
        side = lambda v: F.greatest(F.when(over, near(v * far)).otherwise(v), F.lit(1)).cast("int")
        return F.struct(side(s["w"]).alias("w"), side(s["h"]).alias("h"))

    by_edge = bound(F.struct(near(w * scale).alias("w"), near(h * scale).alias("h")), bounded)
    fixed = F.struct(size["width"].alias("w"), size["height"].alias("h"))
    return F.when(config["do_resize"], F.when((size["height"] > 0) & (size["width"] > 0), fixed).when(size["shortest_edge"] > 0, by_edge))
