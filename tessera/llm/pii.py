"""Personal data: base matchers and bootstrapped contextual extraction.

Base entities (email, ip, card, phone) are matched by pattern and validated.
They seed a bootstrap over the whole corpus: the words around a seed make
lexical patterns; patterns and the instances they meet make a bipartite graph.
In every round patterns are scored by what is sure among their instances
against what is seen elsewhere; instances of trusted patterns become seeds of
the next round, so patterns that no base entity ever met can be trusted, too.
Trusted patterns mark identifiers that no matcher knows.

All of it is DataFrame expressions.  Spark has no match positions, so they are
rebuilt from the pieces between matches (split) and the matches
(regexp_extract_all), whose lengths add up to code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_hot, let, staged, words

#: Kinds in listed order, and what a text must hold for the pattern to be tried.
#: The patterns are the contract's with possessive repetitions, which match the
#: same (nothing follows a repetition that could make it give back) without
#: recursion; an anchor at the start of a run keeps long runs linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": (r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?+[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
FOUND = "contextual"
#: Printable ASCII and its place in the private-use area: base entities are
#: written so in the text whose units are looked at.
PLAIN = "".join(map(chr, range(0x20, 0x7F)))
HIDDEN = "".join(chr(0xE000 + ord(c)) for c in PLAIN)
_SEED = f"{HIDDEN[0]}-{HIDDEN[-1]}"
#: The place of a neighbouring unit in a context, and what stands for private-use characters of the text itself.
NEAR, OTHER = "\ue001", "\uf8ff"
#: What frames a match.
MARK = "\ue002"
#: Rounds of the bootstrap; sure instances that a pattern needs; confidence of
#: a trusted pattern; share of its instances that must be sure.
ROUNDS, SUPPORT, CONFIDENT, SHARE = 4, 3, 0.8, 0.2
#: Patterns that an instance is granted without doubt.
FEW = 6


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3) & F.forall(
            F.split(match, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("00"), F.regexp_replace(p, "^0+", "")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def running(a: Column) -> Column:
    """Prefix sums of an array of numbers, in a few passes over all elements.

    Each pass adds up sixteen sums of the last one, so the cost is n log n.
    """

    def wider(d: int):
        sums = lambda v, i: sum((F.coalesce(F.get(v, i - j * d), F.lit(0)) for j in range(1, 16)), F.get(v, i))
        return lambda v: F.when(F.size(v) <= d, v).otherwise(F.transform(v, lambda x, i: sums(v, i)))

    for k in range(8):  # an array has fewer than 2^31 elements
        a = let(a, wider(16**k))
    return a


def pieces(text: Column, pattern: str) -> Column:
    """struct<parts, hits>: the matches of a pattern, and what stands before, between and after them.

    Matches are framed by a mark and the text is cut at it, one pass of the
    pattern; a text that holds the mark is passed twice instead.
    """
    framed = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    turns = lambda a, k: F.transform(F.sequence(F.lit(k), F.size(a) - 1, F.lit(2)), lambda i: F.get(a, i))
    none = F.array().cast("array<string>")
    fast = let(framed, lambda a: F.struct(turns(a, 0).alias("parts"), F.when(F.size(a) > 1, turns(a, 1)).otherwise(none).alias("hits")))
    slow = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(F.contains(text, F.lit(MARK)), slow).otherwise(fast)


def _placed(x: Column) -> Column:
    """array<struct<start, match>> of pieces."""
    steps = F.transform(x["hits"], lambda h, i: F.length(F.get(x["parts"], i)) + F.coalesce(F.length(F.get(x["hits"], i - 1)), F.lit(0)))
    return F.when(F.size(x["hits"]) > 0, F.zip_with(running(steps), x["hits"], lambda start, hit: F.struct(start.alias("start"), hit.alias("match")))).otherwise(F.array().cast("array<struct<start:int,match:string>>"))


def positions(text: Column, pattern: str) -> Column:
    """array<struct<start, match>> of all matches of a pattern, in code points."""
    return let(pieces(text, pattern), _placed)


def _spans_of(hits: Column, kind: str, rank: int) -> Column:
    good = F.filter(hits, lambda x: _valid(kind, x["match"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["match"])).alias("end")))


def _spans(text: Column) -> Column:
    """Base spans as array<struct<start, rank, end>>, sorted."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    lists = []
    for rank, kind in enumerate(KINDS):
        needs, pattern = PATTERNS[kind]
        first = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))
        lists.append(F.when(first & text.rlike(needs), _spans_of(positions(text, pattern), kind, rank)).otherwise(none))
    return F.array_sort(F.concat(*lists))


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, FOUND)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _hidden(text: Column, spans: Column) -> Column:
    """The text with its base entities written in private-use characters, lengths kept.

    Kind by kind, each in the text that the last one left, from the pieces
    between matches: linear in the text.
    """

    def written(kind: str, rank: int):
        pattern = PATTERNS[kind][1]
        hide = lambda h: F.when(_valid(kind, h), F.translate(h, PLAIN, HIDDEN)).otherwise(h)
        joined = lambda x: F.array_join(F.zip_with(x["parts"], x["hits"], lambda p, h: F.concat(p, F.coalesce(hide(h), F.lit("")))), "")
        whole = lambda t: let(pieces(t, pattern), joined)
        return lambda t: F.when(F.exists(spans, lambda s: s["rank"] == rank), whole(t)).otherwise(t)

    own = f"[{_SEED}{NEAR}{MARK}]"
    text = F.when(text.rlike(own), F.regexp_replace(text, own, OTHER)).otherwise(text)
    for rank, kind in enumerate(KINDS):
        text = let(text, written(kind, rank))
    return text


#: Units, tried at the starts of tokens alone: a token with a base entity, a run
#: of tokens with digits, a token of capitals.  Plain words, nearly all tokens,
#: are passed over by a look-ahead of simple classes.
_WORD = r"[A-Z]?[a-z\xdf-\xff]*+[.,;:!?]*+(?!\S)"
_DIGITS = rf"[^\s0-9{_SEED}]*+[0-9][^\s{_SEED}]*+(?!\S)"
_UNIT = rf"(?<!\S)(?!{_WORD})(?:[^\s{_SEED}]*+[{_SEED}]\S*+|{_DIGITS}(?:\x20{_DIGITS})*+|[^\sA-Za-z0-9]*+[A-Z][A-Z0-9_-]{{5,}}+[^\sA-Za-z0-9]*+(?!\S))"

#: What a text with a candidate holds: four digits of one unit, or capitals.
_LIKELY = r"(?:[0-9][^0-9\s]*+(?: [^0-9\s]*+)?){3}[0-9]|[A-Z][A-Z0-9_-]{5}"


def _units(text: Column, spans: Column) -> Column:
    """array<struct<start, end, seed, instance, patterns>> of seeds and candidates.

    A candidate has at least six characters, four of them digits or all of
    them capitals, digits and joining signs.  Its patterns are hashes of the
    two words before it, and of the word before and the word after it.
    """

    def made(found: Column) -> Column:
        parts, hits = found["parts"], _placed(found)

        def unit(hit: Column, i: Column, parts: Column) -> Column:
            seed = hit["match"].rlike(f"[{_SEED}]")
            core = F.when(seed, F.regexp_extract(hit["match"], f"[{_SEED}]++", 0)).otherwise(F.regexp_extract(hit["match"], r"[0-9A-Za-z](?:.*[0-9A-Za-z])?", 0))
            near = lambda s: words(F.lower(F.regexp_replace(s, "[0-9]+", "9")))
            left = near(F.concat(F.when(i > 0, F.lit(NEAR + " ")).otherwise(F.lit("")), F.get(parts, i)))
            right = near(F.concat(F.get(parts, i + 1), F.when(i + 2 < F.size(parts), F.lit(" " + NEAR)).otherwise(F.lit(""))))

            def patterns(x: Column) -> Column:
                l1, l2, r1 = F.try_element_at(x["left"], F.lit(-1)), F.try_element_at(x["left"], F.lit(-2)), F.get(x["right"], F.lit(0))
                return F.array_compact(F.array(F.when(l2.isNotNull(), F.xxhash64(F.lit("before"), l2, l1)), F.when(l1.isNotNull() & r1.isNotNull(), F.xxhash64(F.lit("around"), l1, r1))))

            around = let(F.struct(left.alias("left"), right.alias("right")), patterns)
            at = lambda c: hit["start"] + F.call_function("locate", c, hit["match"]) - 1
            return let(core, lambda c: F.struct(at(c).alias("start"), (at(c) + F.length(c)).alias("end"), seed.alias("seed"), F.translate(c, HIDDEN, PLAIN).alias("instance"), around.alias("patterns")))

        likely = lambda h: h["match"].rlike(f"[{_SEED}]") | h["match"].rlike("(?:[0-9][^0-9]*+){4}") | ~h["match"].rlike("[0-9]")
        long = lambda u: u["seed"] | (F.length(u["instance"]) >= 6)
        tried = F.filter(F.transform(hits, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: likely(x["h"]))
        return F.filter(F.transform(tried, lambda x: unit(x["h"], x["i"], parts)), long)

    return let(let(_hidden(text, spans), lambda t: pieces(t, _UNIT)), made)


def _with_spans(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("__t"), F.xxhash64(text).alias("__h"), F.when(text.rlike(r"[0-9@]"), let(text, _spans)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("__base"))


def bootstrap(units: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(pattern, score) of the trusted patterns, and the instances that are sure.

    ``units`` has (pattern, instance, seed) rows; seeds are sure.  Edges are
    distinct, so a frequent pattern weighs by its instances, not by its
    occurrences.  In a round, a pattern that meets a sure instance scores
    ``sure / (sure + doubt + 0.5)``; the doubt of another instance of it is
    ``unmet / (patterns + FEW)``, from the number of that instance's patterns
    (but for those of no other instance) and of those that meet nothing sure.
    So numbers seen everywhere are doubtful, while one seen in this context
    and in one other is hardly for or against it.  A pattern is
    trusted with ``support`` sure instances that are at least ``share`` of its
    instances and a score of ``confident``; its instances of little doubt are
    sure from then on.  Rounds end when nothing new is sure.
    """
    edges = staged(units.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    # a pattern of one instance says nothing of others
    many = staged(edges.groupBy("pattern").agg(F.count("*").alias("n")).where("n > 1").withColumn("c", F.col("n")), "many")
    edges = staged(join_hot(edges, many, "pattern", edges.count()), "edges")
    total = edges.count()
    sure = staged(edges.where("seed").select("instance").distinct(), "sure")
    trusted, known = None, sure.count()
    for _ in range(rounds):
        marked = edges.join(sure.withColumn("sure", F.lit(True)), "instance", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
        met = staged(marked.groupBy("pattern").agg(F.count_if("sure").alias("pos"), F.count("*").alias("c")).where("pos > 0"), "met")
        other = join_hot(marked.where("not sure"), met.select("pattern", F.lit(True).alias("met"), "c"), "pattern", total, "left")
        doubt = staged(other.groupBy("instance").agg((F.count_if(F.col("met").isNull()) / (F.count("*") + FEW)).alias("doubt")), "doubt")
        other = join_hot(edges, met.where(F.col("pos") >= support).select("pattern", "c"), "pattern", total).join(doubt, "instance").groupBy("pattern").agg(F.sum("doubt").alias("doubt"))
        scored = met.join(other, "pattern", "left").withColumn("score", F.col("pos") / (F.col("pos") + F.coalesce("doubt", F.lit(0.0)) + 0.5))
        trusted = staged(scored.where((F.col("pos") >= support) & (F.col("score") >= confident) & (F.col("pos") >= share * F.col("c"))).select("pattern", "score", "c"), "trusted")
        found = join_hot(edges, trusted.select("pattern", "c"), "pattern", total).join(doubt.where(F.col("doubt") <= 1 - confident + 1e-9), "instance", "left_semi").select("instance")
        sure = staged(sure.unionByName(found).distinct(), "sure")
        before, known = known, sure.count()
        if known == before:
            break
    return trusted.select("pattern", "score"), sure


def find_pii(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Spans of personal data of every document.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base (array of
    start, rank, end; ranks as in KINDS), found (contextual ones, likewise),
    base_sha256 and spans.  Spans that start together are in the order of
    kinds.  Null text is empty; a text of any length is read whole, at a cost
    that grows with its length and the logarithm of its matches.  One row for
    each input row; repeated rows and null ids give their results each.  Empty
    tables give no rows; other columns are not read.
    """
    rows = _with_spans(docs)
    units = rows.where(F.col("__t").rlike(_LIKELY) | (F.size("__base") > 0)).select("doc_id", "__h", F.explode(let(F.struct("__t", "__base"), lambda x: _units(x["__t"], x["__base"]))).alias("u"))
    flat = staged(units.select("doc_id", "__h", "u.start", "u.end", "u.seed", F.xxhash64("u.instance").alias("instance"), F.explode("u.patterns").alias("pattern")), "units")
    patterns, sure = bootstrap(flat.select("pattern", "instance", "seed"), rounds, support, confident)
    hits = flat.where(~F.col("seed")).join(patterns.select("pattern"), "pattern", "left_semi").join(sure, "instance", "left_semi").select("doc_id", "__h", F.struct("start", F.lit(len(KINDS)).alias("rank"), "end").alias("s"))
    found = hits.groupBy("doc_id", "__h").agg(F.array_sort(F.collect_set("s")).alias("found"))
    key = lambda df: df.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slim = key(rows.select("doc_id", "__h", F.col("__base").alias("base"))).join(key(found).drop("doc_id"), ["__id", "__h"], "left")
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return slim.withColumn("found", F.coalesce("found", none)).select(
        "doc_id", *(n(r).alias(f"n_{k}") for r, k in enumerate(KINDS)), "base", "found", F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.array_sort(F.concat("base", "found"))).alias("spans")
    )
