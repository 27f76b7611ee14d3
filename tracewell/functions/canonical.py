"""Canonical JSON and hashed identities as column expressions."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType, VariantType

CANONICALIZATION_VERSION = 1
IDENTITY_VERSION = 1
EXAMPLE_ID = r"^ex_[0-9a-f]{64}$"
OCCURRENCE_ID = r"^occ_[0-9a-f]{64}$"
#: Control characters that Spark and canonical JSON escape with hexadecimal digits of another case.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(text: Column) -> Column:
    """Canonical composition; only texts beyond ASCII reach Python."""
    return F.coalesce(_nfc(F.when(F.octet_length(text) != F.char_length(text), text)), text)


def json_string(text: Column) -> Column:
    """text as a JSON string, unescaped beyond ASCII; null gives null."""
    whole = F.to_json(F.struct(text.alias("v")))
    plain = F.substring(whole, 6, 2_000_000_000)
    plain = F.regexp_replace(plain, r"\}$", "")
    fixed = plain
    for code in _LETTERED:
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(text.isNull(), F.lit(None)).otherwise(F.when(text.rlike(r"[\x00-\x1f]"), fixed).otherwise(plain))


@F.pandas_udf(StringType())
def _number(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None or v != v else json.dumps(float(v)))


def json_number(value: Column) -> Column:
    """A double as canonical JSON: -0.0 is 0.0; only very small and large values reach Python."""
    value = F.when(value == 0, F.lit(0.0)).otherwise(value)
    plain = (value == 0) | F.abs(value).between(1e-3, 9_999_999.0)
    return F.when(plain, value.cast("string")).otherwise(_number(F.when(~plain, value)))


def content_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def example_json(prompt: Column, completion: Column, weight: Column | None = None, labels_json: Column | None = None, metadata_json: Column | None = None) -> Column:
    """The canonical record: sorted keys, compact separators."""
    weight = F.lit("1.0") if weight is None else F.coalesce(json_number(weight.cast("double")), F.lit("1.0"))
    labels = F.lit("null") if labels_json is None else F.coalesce(labels_json, F.lit("null"))
    metadata = F.lit("{}") if metadata_json is None else F.coalesce(metadata_json, F.lit("{}"))
    return F.concat(
        F.lit(f'{{"canonicalization_version":{CANONICALIZATION_VERSION},"completion":'), json_string(completion), F.lit(',"labels":'), labels,
        F.lit(',"metadata":'), metadata, F.lit(',"prompt":'), json_string(prompt), F.lit(',"sample_weight":'), weight, F.lit("}"),
    )


def example_id(prompt: Column, completion: Column, weight: Column | None = None, labels_json: Column | None = None, metadata_json: Column | None = None) -> Column:
    """ex_ and the SHA-256 of the canonical record; null where prompt or completion is."""
    return F.concat(F.lit("ex_"), content_hash(example_json(prompt, completion, weight, labels_json, metadata_json)))


def occurrence_id(run_id: Column, step: Column, microbatch: Column, position: Column, start: Column, end: Column, example: Column) -> Column:
    """occ_ and the SHA-256 of one use's coordinates; run ids have no white space."""
    text = F.concat(
        F.lit('{"batch_position":'), position.cast("string"), F.lit(',"example_id":'), json_string(example), F.lit(',"global_step":'), step.cast("string"),
        F.lit(f',"identity_schema_version":{IDENTITY_VERSION},"microbatch_index":'), microbatch.cast("string"), F.lit(',"packed_token_span":{"end":'), end.cast("string"),
        F.lit(',"start":'), start.cast("string"), F.lit('},"run_id":'), json_string(run_id), F.lit("}"),
    )
    return F.concat(F.lit("occ_"), content_hash(text))


def packed_id(run_id: Column, step: Column, microbatch: Column, position: Column, count: Column, examples: Column) -> Column:
    """pack_ and the SHA-256 of a sequence's place and its examples' ids (an array)."""
    listed = F.concat(F.lit('["'), F.array_join(examples, '","'), F.lit('"]'))
    listed = F.when(F.size(examples) == 0, F.lit("[]")).otherwise(listed)
    text = F.concat(
        F.lit('{"batch_position":'), position.cast("string"), F.lit(',"examples":'), listed, F.lit(',"microbatch":'), microbatch.cast("string"), F.lit(',"packed_sequence_count":'), count.cast("string"),
        F.lit(',"run_id":'), json_string(run_id), F.lit(',"step":'), step.cast("string"), F.lit("}"),
    )
    return F.concat(F.lit("pack_"), F.sha2(text, 256))


def packed_sequence_id(run_id: str, step: int, microbatch: int, position: int, count: int, examples: list[str], reserved: bool = False) -> str:
    """The same on the driver; a reserved row that does nothing has one example and an id of its own kind."""
    own = {"reserved_noop": True, "example": examples[0]} if reserved else {"examples": examples}
    seed = {"run_id": run_id, "step": step, "microbatch": microbatch, "batch_position": position, "packed_sequence_count": count, **own}
    return ("noop_" if reserved else "pack_") + hashlib.sha256(json.dumps(seed, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cache_key(**fields: Column) -> Column:
    """SHA-256 of string fields as a JSON object of sorted keys."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + json.dumps(name) + ":"), json_string(fields[name])]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


class CanonicalError(ValueError):
    """A value that canonical JSON can't hold."""


def normalized(value: Any, depth: int = 64, items: int = 100_000) -> Any:
    """value with NFC strings and keys and no negative zero; bounded in depth and size, without cycles."""
    left = [items]
    open_: set[int] = set()

    def visit(v: Any, level: int) -> Any:
        left[0] -= 1
        if left[0] < 0 or level > depth:
            raise CanonicalError("the value is too large or too deep")
        if v is None or isinstance(v, bool | int):
            return v
        if isinstance(v, float):
            if not math.isfinite(v):
                raise CanonicalError("numbers must be finite")
            return v + 0.0 if v else 0.0
        if isinstance(v, str):
            return unicodedata.normalize("NFC", v)
        if isinstance(v, dict | list | tuple):
            if id(v) in open_:
                raise CanonicalError("the value has a cycle")
            open_.add(id(v))
            if isinstance(v, dict):
                out: Any = {}
                for k, x in v.items():
                    if not isinstance(k, str):
                        raise CanonicalError("keys must be strings")
                    k = unicodedata.normalize("NFC", k)
                    if k in out:
                        raise CanonicalError("two keys are one after normalization")
                    out[k] = visit(x, level + 1)
            else:
                out = [visit(x, level + 1) for x in v]
            open_.discard(id(v))
            return out
        raise CanonicalError(f"a value of type {type(v).__name__}")

    return visit(value, 0)


def canonical_json(value: Any) -> str:
    return json.dumps(normalized(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _distinct(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise CanonicalError("a key occurs twice")
    return out


def _finite(text: str) -> Any:
    raise CanonicalError(f"{text} is no number")


def canonical_json_text(text: str) -> str:
    """A JSON text in canonical form; a key that occurs twice, before or after normalization, is refused."""
    try:
        value = json.loads(text, object_pairs_hook=_distinct, parse_constant=_finite)
    except json.JSONDecodeError as e:
        raise CanonicalError(f"not JSON: {e}") from None
    return canonical_json(value)


@F.arrow_udf(StringType())
def _canonical_text(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else canonical_json_text(t) for t in texts.to_pylist()], pa.string())


def canonical_text(text: Column) -> Column:
    """A column of JSON texts in canonical form; null stays null, and a text that isn't JSON fails the read."""
    return _canonical_text(text)


def _python(value: Any, kind: DataType) -> Any:
    """A value as Arrow gives it with its maps as objects."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _python(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, ArrayType):
        return [_python(v, kind.elementType) for v in value]
    if isinstance(kind, MapType):
        return _distinct([(k, _python(v, kind.valueType)) for k, v in value])
    if isinstance(kind, VariantType):
        return json.loads(value, object_pairs_hook=_distinct, parse_constant=_finite)
    return value


def _keys(kind: StructType) -> list[tuple[str, Any]]:
    """Normalized names and fields of a struct, in order; two names that become one are refused."""
    named = {unicodedata.normalize("NFC", f.name): f for f in kind.fields}
    if len(named) < len(kind.fields):
        raise CanonicalError("two keys are one after normalization")
    return sorted(named.items())


def _supported(kind: DataType) -> None:
    if isinstance(kind, StructType):
        for _, f in _keys(kind):
            _supported(f.dataType)
    elif isinstance(kind, ArrayType):
        _supported(kind.elementType)
    elif isinstance(kind, MapType):
        if not isinstance(kind.keyType, StringType):
            raise CanonicalError("keys must be strings")
        _supported(kind.valueType)
    elif not isinstance(kind, StringType | BooleanType | IntegralType | FloatType | DoubleType | NullType | VariantType):
        raise CanonicalError(f"a value of type {kind.simpleString()}")


def _easy(value: Column, kind: DataType) -> Column | None:
    """Whether the engine itself can write a value: only ASCII strings and numbers that it prints alike. None: always."""
    if isinstance(kind, StringType):
        return F.coalesce(F.octet_length(value) == F.char_length(value), F.lit(True))
    if isinstance(kind, FloatType | DoubleType):
        size = F.abs(value.cast("double"))
        return F.coalesce((size == 0) | size.between(1e-3, 9_999_999.0), F.lit(True))
    if isinstance(kind, VariantType):
        return value.isNull()
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, NullType | BooleanType | IntegralType):
            return None
        return F.coalesce(F.forall(value, lambda x: _or_true(_easy(x, kind.elementType))), F.lit(True))
    if isinstance(kind, MapType):
        return F.coalesce(F.forall(F.map_entries(value), lambda e: _or_true(_easy(e["key"], kind.keyType)) & _or_true(_easy(e["value"], kind.valueType))), F.lit(True))
    if isinstance(kind, StructType):
        parts = [x for f in kind.fields if (x := _easy(value.getField(f.name), f.dataType)) is not None]
        return None if not parts else F.coalesce(value.isNull() | reduce(lambda a, b: a & b, parts), F.lit(True))
    return None


def _or_true(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else condition


def _written(value: Column, kind: DataType) -> Column:
    """The canonical text of a value that is easy to write."""
    if isinstance(kind, StructType):
        parts: list[Column] = [F.lit("{")]
        for i, (name, f) in enumerate(_keys(kind)):
            parts += [F.lit("," * bool(i) + json.dumps(name, ensure_ascii=False) + ":"), _written(value.getField(f.name), f.dataType)]
        out = F.concat(*parts, F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _written(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        own = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), _written(e["value"], kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(own, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, StringType):
        out = json_string(value)
    elif isinstance(kind, FloatType | DoubleType):
        number = value.cast("double")
        out = F.when(number == 0, F.lit("0.0")).otherwise(number.cast("string"))
    else:
        out = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def canonical_column(value: Column, kind: DataType) -> Column:
    """A column of type kind as canonical JSON texts: keys of structs and maps sorted, keys and strings normalized (NFC), numbers as Python prints
    them, nulls (a whole value too) as null.

    The schema is walked once, and what it makes is an expression of the engine's own functions; rows with strings beyond ASCII, very
    small or large numbers or a variant go through Python in Arrow batches instead. Names that become one by normalization, numbers that
    aren't finite and types that JSON hasn't are refused."""
    _supported(kind)
    if isinstance(kind, StringType):
        return F.coalesce(json_string(nfc(value)), F.lit("null"))
    easy = _easy(value, kind)
    if easy is None:
        return _written(value, kind)

    @F.arrow_udf(StringType())
    def walked(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else canonical_json(_python(v, kind)) for v in values.to_pylist()], pa.string())

    hard = F.when(~easy, value)
    return F.when(easy, _written(value, kind) if not isinstance(kind, VariantType) else F.lit("null")).otherwise(walked(_textual(hard, kind)))


def _textual(value: Column, kind: DataType) -> Column:
    """value with its variants as JSON texts, which is how Python takes them."""
    if "variant" not in kind.simpleString():
        return value
    if isinstance(kind, VariantType):
        return F.to_json(value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_textual(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _textual(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _textual(x, kind.valueType))
    return value
