"""Settings and model lists: precedence, coercion, and what a server says a model can do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(explicit: Column, env: Column, default: str, blank_env: bool = True) -> Column:
    """The explicit value unless blank, else the environment's (a blank one only if ``blank_env``), else the default."""
    return F.coalesce(F.nullif(explicit, F.lit("")), env if blank_env else F.nullif(env, F.lit("")), F.lit(default))


def base_url(explicit: Column, env: Column, default: str) -> Column:
    return F.regexp_replace(given(explicit, env, default), r"/+\z", "")


def truth(raw: Column, default: bool) -> Column:
    """1, true, yes and on, in any case, are true, anything else that is there false."""
    return F.when(raw.isNull(), F.lit(default)).otherwise(F.lower(F.trim(raw)).isin("1", "true", "yes", "on"))


def whole(raw: Column, default: int) -> Column:
    """A whole number, or the default where it is missing or senseless."""
    return F.coalesce(F.when(raw.rlike(r"^\s*[+-]?\d+\s*\z"), F.trim(raw).try_cast("int")), F.lit(default))


def sees_images(model: Column) -> Column:
    """Whether a model reads images, from the variant that a server gives of it; null where the server does not say.

    In this order: architecture.input_modalities holds image; capabilities.vision; capabilities is a list
    with multimodal; input_modalities or modalities holds image.
    """

    def holds(path: str, word: str) -> Column:
        return F.array_contains(F.try_variant_get(model, path, "array<string>"), word)

    said = F.try_variant_get(model, "$.capabilities.vision", "variant")
    flag = F.when(F.schema_of_variant(said) == "BOOLEAN", F.try_variant_get(model, "$.capabilities.vision", "boolean"))
    listed = F.when(holds("$.capabilities", "multimodal"), F.lit(True))
    return F.coalesce(holds("$.architecture.input_modalities", "image"), flag, listed, holds("$.input_modalities", "image"), holds("$.modalities", "image"))
