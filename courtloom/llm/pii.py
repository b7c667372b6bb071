"""Personal data in narrations: base patterns, and bootstrapped extraction from the contexts they stand in.

All of it is built of DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import dealt_anew, free_prefix
from courtloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A look-behind (or the end of the last match, \G) starts each run once and possessive
#: repeats never go back, so a long run of signs costs linear time and no stack; what they match is the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be looked for at all.
_NEEDS = {"email": "@", "phone": "+"}
#: Runs of tokens that hold a digit or an at sign: the candidates for unseen identifiers.
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]{0,2}+[0-9]\S*+)*+"
_GROUP = 256


def located(text: Column, pattern: str) -> Column:
    """array<struct<hit, start, before>> of the non-overlapping matches: `start` counts code points, `before` ends the
    text in front of the match. Starts are sums of piece lengths, added up in groups so that many matches stay cheap."""
    def summed(values: Column, upto: Column, since: Column) -> Column:
        return F.aggregate(F.slice(values, since + 1, upto), F.lit(0), lambda a, v: a + v)

    def place(x: Column) -> Column:
        def at(y: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                before = F.element_at(y["p"], i + 1)
                group = F.floor(i / F.lit(_GROUP)).cast("int")
                start = F.element_at(y["g"], group + 1) + summed(y["n"], F.pmod(i, F.lit(_GROUP)), group * _GROUP) + F.length(before)
                return F.struct(h.alias("hit"), start.cast("int").alias("start"), F.right(before, F.lit(60)).alias("before"))

            return F.transform(y["h"], one)

        def grouped(y: Column) -> Column:
            last = F.floor((F.size(y["h"]) - 1) / F.lit(_GROUP)).cast("int")
            sums = F.transform(F.sequence(F.lit(0), last), lambda g: summed(y["n"], F.lit(_GROUP), g * _GROUP))
            offsets = F.transform(F.array(sums), lambda s: F.transform(F.sequence(F.lit(0), last), lambda g: summed(s, g, F.lit(0))))[0]
            return F.transform(F.array(F.struct(y["p"].alias("p"), y["h"].alias("h"), y["n"].alias("n"), offsets.alias("g"))), at)[0]

        lengths = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["h"])), x["h"], lambda p, h: F.length(p) + F.length(h))
        return F.when(F.size(x["h"]) > 0, F.transform(F.array(F.struct(x["p"].alias("p"), x["h"].alias("h"), lengths.alias("n"))), grouped)[0])

    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    return F.transform(F.array(found), place)[0]


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(13, 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def base_hits(text: Column, kind: str) -> Column:
    """All matches of a base pattern, valid or not; null without any."""
    needs = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(needs, located(text, PATTERNS[kind]))


def base_spans(hits: Column, kind: str) -> Column:
    """array<struct<kind, start, end>> of the valid matches; kind counts in the order of KINDS."""
    spans = F.transform(F.filter(hits, lambda h: _valid(kind, h["hit"])),
                        lambda h: F.struct(F.lit(KINDS.index(kind)).alias("kind"), h["start"].alias("start"), (h["start"] + F.length(h["hit"])).alias("end")))
    return F.coalesce(spans, F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def span_list(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _contexts(found: DataFrame) -> DataFrame:
    """One or two rows for each candidate: (row, start, end, pattern, instance, kind of the base span it meets or null).

    A pattern is the two words in front and the key of a `key=value` token, with the class of the value; an address (a value
    with an @) and a long number (nine digits or more) also have the pattern of their form alone, as an identifier that
    fails a base pattern often has another class than those that pass."""
    c = found.select("row", "base", F.explode("candidates").alias("c"))
    token, start = F.col("c.hit"), F.col("c.start")
    c = c.select("row", "base", "c", token.alias("token"), start.alias("start"),
                 F.regexp_extract(token, "^([^=:@]{0,40}[=:])?[\"'(\\[<]*", 0).alias("lead"))
    c = c.withColumn("value", F.regexp_replace(F.expr("substring(token, length(lead) + 1)"), "[\"')\\]>,.;:!?]+$", ""))
    c = c.withColumn("start", F.col("start") + F.length("lead")).withColumn("end", F.col("start") + F.length("value")).filter("length(value) > 0")
    met = F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), r"\p{L}+", "a"), "(?:9a|a9)[9a]*", "x")
    words = F.lower(F.regexp_extract(F.col("c.before"), r"(?<!\S)((?:\S+\s+)?\S+)\s+$", 1))
    form = F.when(F.contains("value", F.lit("@")), "\x02@").when(F.length(F.regexp_replace("value", "[^0-9]", "")) >= 9, "\x02#")
    patterns = F.filter(F.array(*[F.concat(F.concat_ws("\x01", words, F.lower("lead")), F.lit("\x01"), x) for x in (F.left(signs, F.lit(16)), form)]), lambda p: p.isNotNull())
    return c.select("row", "start", "end", F.explode(patterns).alias("pattern"),
                    F.lower("value").alias("instance"), F.when(F.size(met) > 0, met[0]["kind"]).alias("kind"))


def discover(contexts: DataFrame, rounds: int = 3, least_seeds: int = 3, least_confidence: float = 0.6) -> DataFrame:
    """(instance, kind): unseen identifiers, scored over the graph of patterns and instances.

    In each round the confidence of a pattern for a kind is the share of its distinct instances that are known to be of
    it (patterns with fewer than `least_seeds` known ones do not count); an instance's score is 1 - the product of
    (1 - confidence) over its patterns; instances of at least `least_confidence` become known. Patterns and instances
    are grouped with partial sums, and each round is checkpointed; it ends early when nothing new is known.
    """
    edges = cut_lineage(contexts.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    known = cut_lineage(edges.filter("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")))
    seeds, size = known, known.count()
    for _ in range(rounds if size else 0):
        marked = edges.select("pattern", "instance").join(known, "instance", "left")
        by_kind = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(len(KINDS))]
        rated = marked.groupBy("pattern").agg(F.count("*").alias("n"), *by_kind)
        rated = rated.select("pattern", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("seen"), (F.col(f"n{k}") / F.col("n")).alias("confidence"))
                                                            for k in range(len(KINDS))])).alias("r")).select("pattern", "r.*")
        rated = rated.filter((F.col("seen") >= least_seeds) & (F.col("confidence") >= least_confidence / 2))
        votes = edges.select("pattern", "instance").join(rated, "pattern").groupBy("instance", "kind").agg(
            F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))).alias("log_miss"))
        fresh = votes.filter(1 - F.exp("log_miss") >= least_confidence).join(known.select("instance"), "instance", "left_anti")
        fresh = fresh.groupBy("instance").agg(F.min_by("kind", F.struct("log_miss", "kind")).alias("kind"))
        known = cut_lineage(known.union(fresh))
        last, size = size, known.count()
        if last == size:
            break
    return known.join(seeds.select("instance"), "instance", "left_anti")


def _found(narrations: DataFrame) -> DataFrame:
    """(row, job_id, digest of the text, base, candidates) of each row, checkpointed; the texts are read once and not shuffled."""
    text = F.coalesce(F.col("summary"), F.lit(""))
    hits = narrations.select("job_id", F.monotonically_increasing_id().alias("row"), *[base_hits(text, k).alias(k) for k in KINDS],
                             F.when(text.rlike("[0-9@]"), located(text, _CANDIDATE)).alias("candidates"),
                             F.when(text.rlike("[0-9@]"), F.md5(text.cast("binary"))).alias("digest"))
    hits = cut_lineage(hits)
    return hits.select("job_id", "row", "digest", F.concat(*[base_spans(F.col(k), k) for k in KINDS]).alias("base"), "candidates")


def _extra(found: DataFrame) -> tuple[DataFrame, bool]:
    """(row, extra spans) of discovered identifiers, and whether there are any."""
    contexts = cut_lineage(_contexts(found))
    new = discover(contexts)
    extra = cut_lineage(contexts.filter("kind is null").drop("kind").join(new, "instance").groupBy("row").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("extra")))
    return extra, not extra.isEmpty()


def find_personal_data(narrations: DataFrame) -> DataFrame:
    """(job_id, base, spans): arrays of (kind, start, end) in code points, for each row of `narrations`.

    `base` has the valid base spans by kind and start, `spans` also those discovered. A null or empty summary has none.
    Each row is looked at alone but for the shared patterns, so repeated rows have equal spans; other columns are not
    read.
    """
    found = _found(narrations)
    extra, any_ = _extra(found)
    empty = F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)")
    if any_:
        found = found.join(extra, "row", "left")
    else:
        found = found.withColumn("extra", empty)
    return found.select("job_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", empty))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        clear = s["start"] >= a["at"]
        grown = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(clear, grown).otherwise(a["out"]).alias("out"))

    return F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redact(narrations: DataFrame) -> DataFrame:
    """`narrations` with personal data in `summary` replaced; a null summary stays null, other columns stay as they are,
    whatever their names.

    Base spans are replaced where the text is read. Only if identifiers were discovered are texts joined with the spans of
    their discovery, by a digest of the text: equal texts have equal spans, so ids (repeated, null) play no part.
    """
    found = _found(narrations)
    extra, any_ = _extra(found)
    text, mark = F.col("summary"), free_prefix(narrations.columns)
    hits = [base_hits(F.coalesce(text, F.lit("")), k).alias(f"{mark}{k}") for k in KINDS]
    out = narrations.select("*", *hits)
    spans = F.concat(*[base_spans(F.col(f"{mark}{k}"), k) for k in KINDS])
    if any_:
        by_text = found.join(extra, "row").groupBy("digest").agg(F.min(F.array_sort("extra")).alias(f"{mark}extra"))
        out = out.withColumn(f"{mark}digest", F.md5(text.cast("binary")))
        out = out.join(dealt_anew(by_text.withColumnRenamed("digest", f"{mark}digest"), f"{mark}digest"), f"{mark}digest", "left")
        spans = F.concat(spans, F.coalesce(f"{mark}extra", F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)")))
    out = out.withColumn(f"{mark}spans", spans)
    changed = F.when(F.size(f"{mark}spans") > 0, redacted(text, F.col(f"{mark}spans"))).otherwise(text)
    return out.select(*[changed.alias(c) if c == "summary" else F.col(f"`{c}`") for c in narrations.columns])
