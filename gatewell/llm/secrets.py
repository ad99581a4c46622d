"""Secret scans in native DataFrame functions, with corpus-wide ownership frequency.

Each text is scanned for three base kinds (assign, access, hex) and for bare candidate tokens. The hash of every
candidate value is counted over the corpus by distinct repositories and owners: a value under many owners, or in very
many repositories of a few, is a widely copied example; one under few owners and in few repositories looks live. A bare token is reported too where its value is a credential that
some text assigns. Positions are code points, ends exclusive.

Bare candidates are all runs of the characters that an assigned value may have, what stands in a run after a '=' or
'/', and what stands between two of them, of LEAST characters or more: the join with assigned values decides, not the
pattern. A '=' before a value and the dots of a sentence after it are no part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewell.llm import common


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join([_either_case("password"), _either_case("passwd"), _either_case("secret"), _either_case("token"), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
BARE = "[A-Za-z0-9+/_.=-]{12,}"
LEAST = 12  # characters of an assigned value
KINDS = ("assign", "access", "hex", "bare")
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 50  # a value under so many owners, or in so many repositories, is a copied example
MARK = "[REDACTED]"
SPAN = "struct<start:bigint,rank:int,end:bigint,value:binary>"


def _credential(value: Column) -> Column:
    return F.regexp_replace(value, "^=+|\\.+$", "")


def _hash(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def _spans(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """array<span> of the non-overlapping matches from the left, with the hash of the value.

    The text between matches comes from split() and the matches from regexp_extract_all(), so that positions are
    running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    rows = F.arrays_zip(_ends(text, pattern, found).alias("e"), found.alias("m"), values.alias("v"))
    kept = F.filter(rows, lambda r: F.length(r["v"]) >= least) if least else rows
    return F.transform(kept, lambda r: F.struct((r["e"] - F.length(r["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), r["e"].alias("end"), _hash(_credential(r["v"])).alias("value")))


def _ends(text: Column, pattern: str, found: Column) -> Column:
    """array<bigint>: where each of the matches found ends."""
    between = F.split(text, pattern, -1)
    return common.running(F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long")))


def _bare(text: Column) -> Column:
    """array<span> of the bare candidates: of each run the whole, and from and to its '=' and '/'."""
    found = F.regexp_extract_all(text, F.lit(BARE), F.lit(0))
    placed = F.zip_with(_ends(text, BARE, found), found, lambda e, m: F.struct((e - F.length(m)).alias("at"), m.alias("m")))

    def span(at: Column, value: Column) -> Column:
        return common.let(F.regexp_replace(value, "\\.+$", ""), lambda v: F.struct(at.alias("start"), F.lit(KINDS.index("bare")).alias("rank"), (at + F.length(v)).alias("end"), _hash(v).alias("value")))

    def parts(run: Column) -> Column:
        whole = F.array(span(run["at"], run["m"]))
        cuts = F.split(run["m"], "[/=]", -1)
        ends = common.running(F.transform(cuts, lambda p: (F.length(p) + 1).cast("long")))
        pieces = F.zip_with(ends, cuts, lambda e, p: F.struct((e - 1 - F.length(p)).alias("a"), F.length(p).cast("long").alias("n")))
        long = F.length(run["m"]).cast("long")
        both = F.flatten(F.transform(pieces, lambda p: F.array(p, F.struct(p["a"].alias("a"), (long - p["a"]).alias("n")))))
        cut = F.transform(F.array_distinct(F.filter(both, lambda p: p["n"] >= LEAST)), lambda p: span(run["at"] + p["a"], F.substring(run["m"], (p["a"] + 1).cast("int"), p["n"].cast("int"))))
        return F.when(run["m"].rlike("[/=]"), cut).otherwise(whole)

    return F.filter(F.flatten(F.transform(placed, parts)), lambda x: x["end"] - x["start"] >= LEAST)


def _uncovered(spans: Column, base: Column) -> Column:
    """Those spans that no base span covers. base spans are looked at by stretches of about the root of their number."""
    covers = lambda y, x: (y["start"] <= x["start"]) & (x["end"] <= y["end"])

    def within(sorted_base: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(sorted_base))).cast("int")
        lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(sorted_base) - 1) / step).cast("int")), lambda k: common.let(F.slice(sorted_base, k * step + 1, step), lambda part: F.struct(F.get(part, F.lit(0))["start"].alias("start"), F.array_max(F.transform(part, lambda y: y["end"])).alias("end"), part.alias("part"))))
        return common.let(lots, lambda them: F.filter(spans, lambda x: ~F.exists(them, lambda k: F.when(covers(k, x), F.exists(k["part"], lambda y: covers(y, x))).otherwise(False))))

    plain = F.filter(spans, lambda x: ~F.exists(base, lambda y: covers(y, x)))
    return F.when(F.size(base) > common.SHORT, common.let(F.sort_array(base), within)).otherwise(plain)


def candidates(text: Column) -> Column:
    """All base spans and those bare candidates that no base span covers, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
        return F.when(text.rlike(pattern), _spans(text, pattern, kind, group, least).cast(f"array<{SPAN}>")).otherwise(none)

    base = F.concat(of(ASSIGN, "assign", 2, LEAST), of(ACCESS, "access"), of(HEX, "hex"))
    bare = _bare(text).cast(f"array<{SPAN}>")
    free = common.let(base, lambda b: F.concat(b, _uncovered(bare, b)))
    # every kind needs a run of so many characters, so a text without one has no span
    loose = text.rlike(BARE)
    return F.when(loose, F.sort_array(free)).otherwise(none)


def scan(docs: DataFrame, keys: list[str], text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """A row per document: keys and `spans`, array of (start, rank, end, value: SHA-256, n_repos, n_owners, live).

    Null texts count as empty and rows without spans are kept, repeated rows too; an empty table stays empty. A null
    owner or repository counts as one of its own; equal values tie and are all listed. A key may have any name but
    spans. The first table written holds spans and hashes but no text; counts are aggregated by (value, owner,
    repository), map sides first. The verdicts by value are written before spans are joined with them, so that join is
    a plain one, whose large partitions Spark splits where a third of all spans have one value. The work on a long text
    with m matches grows as m to the power of 1.5 at most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"key_{k}") for k, c in enumerate(keys)], F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), candidates(text).alias("spans"))
    held = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = held.filter(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s"))
    use = each.groupBy(F.col("s.value").alias("value"), F.col("owner"), F.col("repo")).agg(F.max((F.col("s.rank") < 2).cast("int")).alias("named"), F.max((F.col("s.rank") < 3).cast("int")).alias("base"))
    by_owner = use.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.max("named").alias("named"), F.max("base").alias("base"))
    seen = by_owner.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.max("named").alias("named"), F.max("base").alias("base")).filter("base = 1").drop("base")
    seen = common.materialize(seen, "verdicts")
    live = ((F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)).alias("live")
    judged = each.select("row", "s.*").join(seen, "value").filter((F.col("rank") < 3) | (F.col("named") == 1))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "value", "n_repos", "n_owners", live))).alias("judged"))
    joined = held.drop("repo", "owner", "spans").join(spans, "row", "left")
    empty = F.array().cast(spans.schema["judged"].dataType)
    return joined.select(*[F.col(f"key_{k}").alias(c) for k, c in enumerate(keys)], F.coalesce("judged", empty).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """text with each of the spans (in order of start, they may overlap) replaced by one mark.

    Spans that begin inside an earlier one vanish in it. The text is taken apart by stretches of spans first, then by
    spans, so a text with many spans isn't walked from its start for each.
    """

    cut = lambda s, at, end: F.substring(s, (at + 1).cast("int"), (end - at).cast("int"))

    def whole(free: Column, tail: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(free))).cast("int")
        last = F.floor((F.size(free) - 1) / step).cast("int")
        long = F.length(text).cast("long")

        def stretch(k: Column) -> Column:
            start = F.get(free, k * step)["before"]
            end = F.coalesce(F.get(free, (k + 1) * step)["before"], long)
            return common.let(cut(text, start, end), lambda own: F.array_join(F.transform(F.slice(free, k * step + 1, step), lambda x: F.concat(cut(own, x["before"] - start, x["start"] - start), F.lit(mark))), ""))

        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), stretch), ""), cut(text, tail, long))

    reach = common.running(F.transform(spans, lambda x: x["end"].cast("long")), lambda a, n: F.greatest(a, n))  # how far this span and those before it go
    placed = common.let(reach, lambda r: F.transform(spans, lambda x, i: F.struct(x["start"].cast("long").alias("start"), F.coalesce(F.get(r, i - 1), F.lit(0).cast("long")).alias("before"))))
    free = F.filter(placed, lambda x: x["start"] >= x["before"])
    masked = common.let(free, lambda f: whole(f, F.array_max(F.transform(spans, lambda x: x["end"].cast("long")))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
