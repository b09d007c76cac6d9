"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sides import free, keyed, let, sized
from firmlens.session import materialise


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The kinds in their order, their patterns and least lengths (of the group that counts).
ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = {"assign": (ASSIGN, 2, 8), "access": ("AKIA[A-Z0-9]{12,}", 0, 16), "hex": ("[0-9a-f]{32,}", 0, 32)}
#: Strings that may be credentials without a telling name; what the corpus knows about their owners decides.
LOOSE = "[A-Za-z0-9+/_=-]{20,}"
#: Pieces of made-up credentials.
MADE_UP = "(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567"


def matches(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, value), in code points, end exclusive.

    Positions follow from the lengths of the matches and of the pieces between them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    span = "struct<start:int,end:int,value:string>"
    none = F.array().cast(f"array<{span}>")

    def walk(m: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            begin = s["at"] + F.length(F.get(m["gaps"], i))
            end = begin + F.length(F.get(m["whole"], i))
            return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.get(m["value"], i).alias("value")))).alias("spans"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m["whole"]) - 1), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]

    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), value.alias("value")), walk)
    return F.when(text.rlike(pattern), found).otherwise(none)


def _tagged(kind: str, order: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3,
    example_repos: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``spans`` (arrays of start, order, end, kind, value) and ``n_live``, ``n_example``.

    ``base`` holds the kinds of ``KINDS``, leftmost and non-overlapping per kind. Every candidate value, with the loose strings of
    20 or more characters that mix letters and digits, is counted over the whole corpus by distinct owners and by repositories, told apart within their owner. A value
    that ``example_owners`` or more owners, or ``example_repos`` or more repositories hold is a widely copied example; another one that holds 8 or more
    distinct characters and no made-up piece is live-looking. Live-looking loose strings that touch no base span are added to ``spans`` as kind ``owned``.
    Values are counted by their SHA-256, so that long ones are not shuffled.

    Null text is scanned as empty and has no spans. A null owner or repository counts as one of its own. Rows that repeat an id keep
    their own spans. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
        F.coalesce(F.concat(F.lit("="), F.col(repo_col).cast("string")), F.lit("")).alias("repo"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"),
    )
    def long_enough(spans: Column, least: int) -> Column:
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    base = F.concat(*[
        _tagged(kind, k, long_enough(matches(text, pattern, group), least)) for k, (kind, (pattern, group, least)) in enumerate(KINDS.items())
    ])
    loose = F.filter(matches(text, LOOSE, 0), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    scanned = source.select("doc_id", "repo", "owner", F.array_sort(base).alias("base"), loose.alias("loose"))
    apart = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    scanned = scanned.select("doc_id", "repo", "owner", "base", _tagged("owned", len(KINDS), apart).alias("loose"))
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")

    value = F.col("c.value")
    likely = (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~value.rlike(MADE_UP)
    every = scanned.select("row", "repo", "owner", F.size("base").alias("n_base"), F.posexplode(F.concat("base", "loose")).alias("at", "c"))
    candidates = every.select("row", "repo", "owner", (F.col("at") - F.col("n_base")).alias("at"), F.unhex(F.sha2(value, 256)).alias("key"), likely.alias("likely"))
    counts = (
        candidates.groupBy("key", "owner", "repo").agg(F.lit(1).alias("n"))
        .groupBy("key", "owner").agg(F.sum("n").alias("n"))
        .groupBy("key").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))
    )
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    counts = materialise(counts.select("key", example.alias("example")), "owners")
    judged = candidates.join(counts, "key").select("row", "at", (F.col("likely") & ~F.col("example")).alias("live"), "example")
    per_row = judged.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum(F.col("example").cast("long")).alias("n_example"),
        F.collect_list(F.when(F.col("live") & (F.col("at") >= 0), F.col("at"))).alias("owned"),
    )
    added = F.filter("loose", lambda c, i: F.array_contains("owned", i))
    return scanned.select("row", "doc_id", "base", "loose").join(per_row, "row", "left").select(
        "doc_id", "base", F.array_sort(F.when(F.col("owned").isNull(), F.col("base")).otherwise(F.concat("base", added))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and span texts of ``find_secrets``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), "n_live", "n_example"
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all columns are kept, clean texts unchanged.

    Spans meet their text by a written key, so every row is masked by its own spans and stays one row, whether its id is unique, repeated or null.
    ``id_col`` is the repository of a row unless ``repo_col`` is given.
    """
    rows, key = keyed(docs, "texts")
    spans = free("_spans", docs.columns)
    found = find_secrets(rows, key, text_col, **{"repo_col": id_col, **options}).where("size(spans) > 0").select(F.col("doc_id").alias(key), F.col("spans").alias(spans))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(F.col(text_col), s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["done"], gap).alias("done"))

    folded = F.aggregate(spans, start, step)
    rest = F.substring(F.col(text_col), folded["at"] + 1, F.length(text_col))
    clean = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat(folded["done"], rest))
    return rows.join(sized(found, "redacted"), key, "left").withColumn(text_col, clean).select(*docs.columns)
