"""Record text: combined attributes, prompt lines, normalisation and token similarity, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word characters and what separates them, spelled out because Java's \w knows ASCII only.
WORD, PUNCTUATION = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_\s]"


def id_column(columns: list[str]) -> str | None:
    """The natural id column: ID, then id, then any other spelling; None if there is none."""
    for exact in ("ID", "id"):
        if exact in columns:
            return exact
    return next((c for c in columns if c.lower() == "id"), None)


def attributes(df: DataFrame, skip: tuple[str, ...] = ("rid", "combined_text")) -> list[str]:
    """Columns that describe the record: neither the natural id nor those in skip."""
    return [c for c in df.columns if c != id_column(df.columns) and c not in skip]


def combined_text(*columns: str) -> Column:
    """Attributes in order, blank-joined; a null reads `nan`."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def data_line(*columns: str) -> Column:
    """Attributes in order, comma-joined."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def prompt_line(rid: str, *columns: str) -> Column:
    """`Record <rid>: ` and the data line."""
    return F.concat(F.lit("Record "), F.col(rid).cast("string"), F.lit(": "), data_line(*columns))


def prompts(records: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """(set_id, prompt): prompt lines of members(set_id, pos, rid) in order of pos; unknown ids are left out."""
    lines = members.join(records.select("rid", prompt_line("rid", *columns).alias("line")), "rid")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("set_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"))


def batched_prompts(tasks: DataFrame, preamble: str = "") -> DataFrame:
    """(batch, prompt) of tasks(batch, pos, task, prompt): the tasks' prompts in order of pos, each under its number."""
    part = F.concat(F.lit("\n### Task T"), F.col("task").cast("string"), F.lit(" ###\n"), F.col("prompt"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"])
    return tasks.groupBy("batch").agg(F.concat_ws("\n", F.lit(preamble), F.array_join(ordered, "\n")).alias("prompt"))


def normalized(text: Column) -> Column:
    """Lower case; punctuation inside words is a blank, other punctuation goes, ends are trimmed."""
    inner = F.regexp_replace(text, f"(?<={WORD}){PUNCTUATION}+(?={WORD})", " ")
    bare = F.regexp_replace(inner, PUNCTUATION, "")
    return F.lower(F.regexp_replace(bare, r"^\s+|\s+$", ""))


def tokens(text: Column) -> Column:
    """Distinct tokens of the normalized text."""
    return F.array_distinct(F.filter(F.split(normalized(text), r"\s+"), lambda x: x != ""))


def char_match_ratio(a: Column, b: Column) -> Column:
    """Share of positions, of the longer text's, at which both have the same character."""
    shorter = F.least(F.length(a), F.length(b))
    positions = F.sequence(F.lit(1), F.greatest(shorter, F.lit(1)))
    same = F.filter(positions, lambda i: (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) & (i <= shorter))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.size(same) / longer)


def prepared(text: Column) -> Column:
    """What token_similarity() needs of a text, computed once per record: tokens, raw text, whether it is one token,
    has a point and starts with a digit."""
    raw = F.trim(text)
    return F.struct(
        tokens(text).alias("tokens"), raw.alias("raw"), (~raw.rlike(r"\s")).alias("one"), raw.contains(".").alias("point"), raw.rlike("^[0-9]").alias("digit")
    )


def single_valued(a: Column, b: Column) -> Column:
    """Whether both prepared() texts are single tokens of which one contains a point."""
    return a["one"] & b["one"] & (a["point"] | b["point"])


def token_similarity(a: Column, b: Column, numeric_guard: bool = False, shared: Column | None = None) -> Column:
    """Jaccard similarity of both prepared() texts' token sets, -1 where either has none; shared: their number of common
    tokens, if it is known.

    Single tokens of which one contains a point compare by character positions instead; numeric_guard asks that
    both also start with a digit."""
    x, y = a["tokens"], b["tokens"]
    single = single_valued(a, b)
    if numeric_guard:
        single = single & a["digit"] & b["digit"]
    shared = F.size(F.array_intersect(x, y)) if shared is None else shared
    overlap = shared / (F.size(x) + F.size(y) - shared)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), -1.0).when(single, char_match_ratio(a["raw"], b["raw"])).otherwise(overlap)


def token_jaccard(a: Column, b: Column, numeric_guard: bool = False) -> Column:
    """token_similarity() of two texts."""
    return token_similarity(prepared(a), prepared(b), numeric_guard)


def prepared_attribute(value: Column) -> Column:
    """prepared() of an attribute; null where it is missing (null or `nan`)."""
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != "nan"), prepared(text))


def attribute_similarity(left: list[Column], right: list[Column]) -> Column:
    """Mean token similarity over prepared attributes that both records have; 0 if none."""
    return mean_similarity([F.when(a.isNotNull() & b.isNotNull(), token_similarity(a, b)) for a, b in zip(left, right, strict=True)])


def mean_similarity(each: list[Column]) -> Column:
    """Mean of the similarities that are neither null nor negative; 0 if none. Plain sums, so that code is generated."""
    n, total = F.lit(0), F.lit(0.0)
    for x in each:
        n, total = n + F.when(x >= 0, 1).otherwise(0), total + F.when(x >= 0, x).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(total / n)


def normalized_id(value: Column) -> Column:
    """An id as text without blanks around it."""
    return F.trim(value.cast("string"))
