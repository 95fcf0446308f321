"""A registry of stage transforms: each stage's default can be passed, replaced or modified by plug-ins."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]
MODES = ("pass", "replace", "modify")


class Stages:
    """Named stages in order.  A plug-in takes and returns a DataFrame: 'pass' leaves the stage out, 'replace' stands for its
    default, 'modify' follows it.  Any number may modify a stage, one may replace or pass it."""

    def __init__(self, **defaults: Transform):
        self.defaults, self.plugins = dict(defaults), {}

    def register(self, stage: str, mode: str, hook: Transform | None = None) -> Stages:
        if stage not in self.defaults:
            raise ValueError(f"unknown stage {stage!r}; stages are {', '.join(self.defaults)}")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; modes are {', '.join(MODES)}")
        if (mode == "pass") != (hook is None):
            raise ValueError("a hook is given for 'replace' and 'modify' only")
        if hook is not None and len(inspect.signature(hook).parameters) != 1:
            raise TypeError(f"the hook of {stage!r} must take one DataFrame")
        own = self.plugins.setdefault(stage, [])
        if mode != "modify" and any(m != "modify" for m, _ in own):
            raise ValueError(f"stage {stage!r} is already replaced or passed")
        own.append((mode, hook))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        """The stages one after the other, as one plan."""
        for stage, default in self.defaults.items():
            own = self.plugins.get(stage, [])
            main = next((h for m, h in own if m != "modify"), default)
            for hook in [main, *(h for m, h in own if m == "modify")]:
                if hook is None:
                    continue
                df = hook(df)
                if not isinstance(df, DataFrame):
                    raise TypeError(f"the hook of {stage!r} returned {type(df).__name__}, not a DataFrame")
        return df


def validated(df: DataFrame, rules: dict[str, Column], out: str = "error") -> DataFrame:
    """Add the message of the first rule that a row breaks (a rule that is null is broken); null for valid rows."""
    failed = F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), message) for message, rule in rules.items()), F.lit(None).cast("string"))
    return df.withColumn(out, failed)


def _is(variant: str, path: str, *kinds: str) -> Column:
    kind = F.schema_of_variant(F.expr(f"try_variant_get({variant}, '{path}', 'variant')"))
    out = F.lit(False)
    for k in kinds:
        out = out | kind.startswith(k)
    return F.coalesce(out, F.lit(False))


def spec_update_rules(variant: str) -> dict[str, Column]:
    """Rules for a decision about a function's metadata, a VARIANT column."""
    get = lambda p, t: F.expr(f"try_variant_get({variant}, '$.{p}', '{t}')")
    names = get("updated_callees", "array<variant>")
    text = F.forall(names, lambda v: F.coalesce((F.schema_of_variant(v) == "STRING") & (F.trim(F.try_variant_get(v, "$", "string")) != ""), F.lit(False)))
    fields = ["spec_updated", "new_spec", "info_updated", "new_info", "updated_callees"]
    # a key with a JSON null is there, so keys are looked up in the text
    keys = F.json_object_keys(F.to_json(F.col(variant)))
    return {
        "must be an object": _is(variant, "$", "OBJECT"),
        "missing fields": F.size(F.array_except(F.array(*map(F.lit, fields)), keys)) == 0,
        "flags must be booleans": _is(variant, "$.spec_updated", "BOOLEAN") & _is(variant, "$.info_updated", "BOOLEAN"),
        "updated_callees must be an array of texts": names.isNotNull() & text,
        "new_spec must be an object": ~get("spec_updated", "boolean") | _is(variant, "$.new_spec", "OBJECT"),
        "new_info must be an object": ~get("info_updated", "boolean") | _is(variant, "$.new_info", "OBJECT"),
    }
