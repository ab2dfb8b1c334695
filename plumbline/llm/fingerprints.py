"""Document fingerprints: sums of wide vectors hashed from paragraphs, modulo powers of two.

A fingerprint is an array of 26 numbers. Four are sums of paragraph hashes modulo 2^62: equal
multisets of paragraphs agree in them whatever their order. Twenty-two hold lanes of 20 bits: each
sentence of a paragraph adds the square root of its length to the lanes that its hash picks, and to
one lane that sums all weights. Twice a lane less that sum is a random-sign projection, so the dot
product of two fingerprints estimates the characters in common sentences. All lanes are sums, so
``combine`` inserts paragraphs and ``without`` deletes them without the rest of the text.

Only DataFrame expressions are used. Defined cases: a null text is empty; an empty text, and one of
line breaks only, has the zero fingerprint; two zero fingerprints have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._columns import whole_text

PARAGRAPH_END = r"\n+"
SENTENCE_END = r"(?<=[.!?])\s+"
_WHOLE = 4  # numbers that hash whole paragraphs
_WHOLE_MASK = (1 << 62) - 1
_FIELD = 21  # 20 bits of a lane and one that takes its carry
_LANE = (1 << 20) - 1
_FIELDS = sum(1 << (_FIELD * k) for k in range(3))
_LANES_MASK = _LANE * _FIELDS
_SHIFTS = 21  # numbers of three lanes each


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _vector_sum(vectors: Column, size: int, mask: int) -> Column:
    zero = F.array_repeat(_long(0), size)
    return F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: (a + b).bitwiseAND(_long(mask))))


def fingerprint(text: Column) -> Column:
    """The array of sums of a text."""
    paragraphs = F.array_remove(F.split(text, PARAGRAPH_END), "")
    whole = F.transform(paragraphs, lambda p: F.array(*[F.xxhash64(F.lit(k), p).bitwiseAND(_long(_WHOLE_MASK)) for k in range(_WHOLE)]))
    sentences = F.array_remove(F.split(text, f"{PARAGRAPH_END}|{SENTENCE_END}"), "")
    hashed = F.transform(
        sentences,
        lambda s: F.struct(F.xxhash64(s).alias("h"), F.ceil(F.sqrt(F.char_length(s))).cast("long").bitwiseAND(_long(_LANE)).alias("w")),
    )
    lanes = F.transform(
        hashed,
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(_SHIFTS)),
            # the last number holds the sum of weights alone
            lambda j: F.when(j < _SHIFTS, _shifted(s["h"], j).bitwiseAND(_long(_FIELDS)) * s["w"]).otherwise(s["w"]),
        ),
    )
    return F.concat(_vector_sum(whole, _WHOLE, _WHOLE_MASK), _vector_sum(lanes, _SHIFTS + 1, _LANES_MASK))


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def _numbers(a: Column, b: Column, whole, lanes) -> Column:
    return F.concat(
        F.zip_with(F.slice(a, 1, _WHOLE), F.slice(b, 1, _WHOLE), whole),
        F.zip_with(F.slice(a, _WHOLE + 1, _SHIFTS + 1), F.slice(b, _WHOLE + 1, _SHIFTS + 1), lanes),
    )


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together: inserts the paragraphs behind ``b``."""
    return _numbers(
        a, b, lambda x, y: (x + y).bitwiseAND(_long(_WHOLE_MASK)), lambda x, y: (x + y).bitwiseAND(_long(_LANES_MASK))
    )


def without(a: Column, b: Column) -> Column:
    """Deletes from ``a`` the paragraphs behind ``b``."""
    carry = (_LANE + 1) * _FIELDS
    return _numbers(
        a,
        b,
        lambda x, y: (x + (_long(_WHOLE_MASK + 1) - y)).bitwiseAND(_long(_WHOLE_MASK)),
        lambda x, y: (x + (_long(carry) - y)).bitwiseAND(_long(_LANES_MASK)),
    )


def as_text(sums: Column) -> Column:
    """The fingerprint as lower-case hex digits, 16 for each number."""
    return F.lower(F.array_join(F.transform(sums, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _projection(sums: Column) -> Column:
    """The signed lanes: twice the lane less all weights, modulo 2^20, around zero."""
    weight = F.element_at(sums, _WHOLE + _SHIFTS + 1)
    half = (_LANE + 1) // 2

    def lane(i: Column) -> Column:
        number = F.element_at(sums, (_WHOLE + 1 + F.floor(i / 3)).cast("int"))
        value = _shifted(number, (i % 3) * _FIELD).bitwiseAND(_long(_LANE))
        return ((value * 2 - weight + _long((_LANE + 1) * 2 + half)).bitwiseAND(_long(_LANE)) - half).cast("double")

    return F.transform(F.sequence(F.lit(0), F.lit(3 * _SHIFTS - 1)), lane)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def projection(sums: Column) -> Column:
    """What ``likeness`` compares: the signed lanes."""
    return _projection(sums)


def likeness(a: Column, b: Column, a_lanes: Column, b_lanes: Column) -> Column:
    """Share of characters in common sentences, 0 to 1, estimated from two fingerprints and their
    projections; 1 for equal ones. Its standard error is about 0.12."""
    both = _dot(a_lanes, a_lanes) + _dot(b_lanes, b_lanes)
    share = F.when(both > 0, 2 * _dot(a_lanes, b_lanes) / both).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def fingerprint_documents(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the array of sums of each text."""
    return docs.withColumn(name, fingerprint(whole_text(text)))


def with_next(docs: DataFrame, key: str, tie: str, carried: list[str], buckets: int) -> DataFrame:
    """Each row with the columns ``carried`` of the next row by descending ``key`` (``next_<name>``);
    the first row follows the last. Nulls come last, ties go by ``tie``.

    Rows are dealt to ranges of the key that hold about equally many, so no task sorts the whole table.
    A range's first row is the next of the row before it: rows at a border go to both ranges.
    """
    facts = docs.agg(
        F.percentile_approx(key, [k / buckets for k in range(1, buckets)] or [0.5], max(10_000, 20 * buckets)).alias("borders"),
        F.max(key).alias("first"),
    ).first()
    borders = sorted(set(facts["borders"] or [])) if buckets > 1 else []
    edges = F.lit(borders).cast("array<bigint>") if borders else F.array().cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    found = (
        F.aggregate(  # binary search: how many borders are at or below the key
            F.lit(steps),
            F.lit(0),
            lambda lo, step: F.when(
                (lo + step <= len(borders)) & (F.element_at(edges, F.least(lo + step, F.lit(len(borders)))) <= F.col(key)), lo + step
            ).otherwise(lo),
        )
        if borders
        else F.lit(0)
    )
    place = F.struct(F.col("__range").alias("range"), F.lit(True).alias("own"))
    borrowed = F.array(
        F.struct(F.col("__range").alias("range"), F.lit(False).alias("own")),
        F.struct((F.col("__range") - 1).alias("range"), F.lit(True).alias("own")),
    )
    at_border = F.element_at(edges, F.greatest(F.col("__range"), F.lit(1))) == F.col(key) if borders else F.lit(False)
    dealt = (
        docs.withColumn("__range", F.when(F.col(key).isNull(), F.lit(0)).otherwise(found))
        .withColumn("__place", F.explode(F.when((F.col("__range") > 0) & at_border, borrowed).otherwise(F.array(place))))
        .select("*", F.col("__place.range").alias("__in"), F.col("__place.own").alias("__own"), F.lit(False).alias("__after"))
    )
    first = (
        docs.where(F.col(key).eqNullSafe(F.lit(facts["first"])))
        .orderBy(tie)
        .limit(1)
        .select("*", F.lit(0).alias("__in"), F.lit(False).alias("__own"), F.lit(True).alias("__after"))
    )
    rows = dealt.drop("__range", "__place").unionByName(first)
    order = Window.partitionBy("__in").orderBy("__after", F.desc_nulls_last(key), tie)
    return (
        rows.withColumns({f"next_{name}": F.lead(name).over(order) for name in carried}).where("__own").drop("__in", "__own", "__after")
    )


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by as many of the following text's first."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))
