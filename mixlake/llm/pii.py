"""Personal data: fixed patterns, and identifiers that bootstrapped contexts and shapes give away.

The spans of the fixed patterns are the seeds. A candidate is a word with a digit or @; it stands in three lexical
patterns: its shape (letters a and A, runs as one, digits 9), the word on its left, and the two words on its left.
Patterns and the candidates' texts, their instances, make a graph. A round scores

    a pattern for a kind:  sum of its instances' scores for that kind / (1 + all places that the pattern has)
    an instance:           the best of its confident patterns' scores

where a seed's text scores 1, and a pattern is confident at CONFIDENCE with SUPPORT different instances or more. For
the places of a left context every word counts that follows it in any text, candidate or not, so common words
are never confident. Rounds go on until no instance is new, ROUNDS at most. Candidates that stand
in a confident pattern, or whose text has become an instance, are found: those of ENOUGH letters and digits, and shorter ones
next to them, such as the code in front of a number.

All of this is DataFrame and SQL functions. A text is cut where it is read and never shuffled; graphs hold 64-bit hashes of
patterns and texts. Contexts are looked up in a broadcast table of SLOTS numbers at most, then exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.llm.secrets import _find, _quoted, _sums
from mixlake.llm.shared import LOWER, UPPER, discard, materialize, table

#: Kinds in the order of their listing.
KINDS = ("email", "ip", "card", "phone")
SPACE, _WHITE = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"
_LOCAL = "A-Za-z0-9._%+-"
#: Fixed patterns. Possessive, and begun only where a run begins or the last match ended: they match what the plain forms do, in linear time.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_DIGITS = "char_length(regexp_replace({h}, '[^0-9]', ''))"
_PART = "trim(LEADING '0' FROM p)"
#: What a hit must pass, as SQL of it.
TESTS = {
    "email": "true",
    "ip": f"forall(split({{h}}, '[.]'), p -> char_length({_PART}) < 3 or (char_length({_PART}) = 3 and {_PART} <= '255'))",
    "card": f"if({_DIGITS} between 13 and 19, luhn_check(regexp_replace({{h}}, '[^0-9]', '')), false)",
    "phone": f"{_DIGITS} between 9 and 15",
}
#: What a text has that any of their hits is in.
NEEDS = {"email": "contains(t, '@')", "ip": "contains(t, '.') and t rlike '[0-9]'", "card": "t rlike '[0-9][ -]?[0-9]'", "phone": "contains(t, '+')"}
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: Any of them, leftmost first; an address begins where its run of letters does.
SEED = "|".join((EMAIL.replace(r"|\G", ""), PHONE, IP, CARD))
#: One for each kind, put before the words of its spans; texts that hold one are read as if they held the last. All are noncharacters of Unicode.
MARKS, OTHER = "\ufdd0\ufdd1\ufdd2\ufdd3", "\ufdd4"
#: A word with a digit, an @ or a mark.
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@{MARKS}]*+[0-9@{MARKS}][^{SPACE}]*+"
#: Around a candidate's word these don't belong to it.
OPENS, CLOSES = "([{<\"'", ")]}>\"'.,;:!?"
#: Text before a candidate from which its context is read, and how much of a context's word counts.
BEFORE, TAIL = 200, 32
CONFIDENCE, SUPPORT, ROUNDS, ENOUGH = 0.8, 5, 4, 7
#: Most letters between neighbours that belong together.
APART = 3
SLOTS = 65_536

_SPAN = "array<struct<kind:int,start:bigint,stop:bigint>>"


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + _quoted(text) + "'"


def _kind_of(h: str) -> str:
    """SQL for the place in KINDS of a hit of any fixed pattern; null if it fails its test."""
    cases = {"email": f"instr({h}, '@') > 0", "phone": f"left({h}, 1) = '+'", "ip": f"{h} rlike {_sql('^[0-9]+([.][0-9]+){3}$')}", "card": "true"}
    return "case " + " ".join(f"when {test} then if({TESTS[k].format(h=h)}, {KINDS.index(k)}, null)" for k, test in cases.items()) + " end"


def _shape(core: str) -> str:
    return f"translate(regexp_replace(regexp_replace({core}, {_sql('[\\p{Ll}]+')}, 'a'), {_sql('[\\p{Lu}]+')}, 'A'), '012345678', '999999999')"


def _opened(word: str) -> str:
    return f"trim(LEADING {_sql(OPENS)} FROM {word})"


def _core(word: str) -> str:
    return f"trim(TRAILING {_sql(CLOSES)} FROM {_opened(word)})"


def _plain(word: str) -> str:
    return f"right({word}, {TAIL})"


def _folded(text: str) -> str:
    return f"translate({text}, '{UPPER}012345678', '{LOWER}999999999')"


def read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, words): of each row the fixed patterns' spans (kind, start, stop), sorted, and its candidates.

    words: (start, stop, kind, strong, inst, shape, left1, left2) in the text's order; kind is -1 outside seeds, strong
    says whether it has ENOUGH letters and digits, the last four are hashes, null where there is no such context. row is a number of its own once written.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.translate(F.coalesce(F.col(text), F.lit("")), MARKS, OTHER * len(MARKS)).alias("t"))
    # a pattern is tried only on texts with a character that it needs; on others it finds nothing
    for k in KINDS:
        rows = rows.withColumn("_may", F.expr(f"if({NEEDS[k]}, t, '')"))
        rows = _find(rows, "_may", PATTERNS[k], f"_{k}", TESTS[k].format(h="{hit}")).drop(f"_{k}_gaps", "_may")
    base = ", ".join(f"transform(filter(_{k}, s -> s.hit is not null), s -> named_struct('kind', {i}, 'start', s.start, 'stop', s.stop))" for i, k in enumerate(KINDS))
    rows = rows.select("row", "doc_id", "t", F.expr(f"array_sort(cast(concat({base}) as {_SPAN}))").alias("base"))
    rows = _find(rows.withColumn("_may", F.expr("if(size(base) > 0, t, '')")), "_may", SEED, "_any")
    mark = f"substring('{MARKS}', k + 1, 1)"
    piece = f"element_at(transform(array({_kind_of('h.whole')}), k -> if(k is null, h.whole, concat({mark}, replace(h.whole, ' ', concat(' ', {mark}))))), 1)"
    rows = rows.select("row", "doc_id", "base", F.expr(f"array_join(zip_with(_any_gaps, _any, (g, h) -> concat(g, if(h is null, '', {piece}))), '')").alias("m"), "t")
    rows = rows.withColumn("m", F.expr("if(size(base) > 0, m, t)")).drop("t")
    p = _sql(CANDIDATE)
    rows = rows.withColumn("hits", F.expr(f"regexp_extract_all(m, {p}, 0)")).withColumn("gaps", F.expr(f"if(size(hits) > 0, split(m, {p}, -1), array(m))"))
    rows = rows.withColumn("bare", F.expr(f"transform(hits, h -> translate(h, '{MARKS}', ''))"))
    rows = rows.withColumn("steps", F.expr("zip_with(bare, slice(gaps, 1, size(hits)), (h, g) -> cast(char_length(g) + char_length(h) as bigint))"))
    rows = rows.withColumn("ends", F.expr(_sums("steps")))
    kind = "case " + " ".join(f"when instr(x.hits, '{m}') > 0 then {k}" for k, m in enumerate(MARKS)) + " else -1 end"
    # each array is named once, so that none is made again for every word
    rows = rows.withColumns({"gap": F.expr("slice(gaps, 1, size(hits))"), "was": F.expr("slice(concat(array(''), bare), 1, size(hits))")})
    rows = rows.withColumn("w", F.arrays_zip("hits", "bare", "ends", "gap", "was"))
    rows = rows.select("row", "doc_id", "base", F.expr(f"transform(w, x -> named_struct('kind', {kind}, 'w', x.bare, 'stop', x.ends, 'before', concat(x.was, x.gap)))").alias("w"))
    before = f"split({_folded(f'trim(BOTH {_sql(_WHITE)} FROM right(x.before, {BEFORE}))')}, '[{_quoted(SPACE)}]+')"
    rows = rows.withColumn("w", F.expr(f"""transform(w, x -> named_struct('kind', x.kind, 'start', x.stop - char_length({_opened('x.w')}), 'core', {_core('x.w')},
        'cut', char_length(x.before) > {BEFORE}, 'before', {before}))"""))
    rows = rows.withColumn("w", F.expr("filter(w, x -> x.core <> '')"))
    known = "if(x.cut, slice(x.before, 2, greatest(size(x.before) - 1, 0)), filter(x.before, y -> y <> ''))"
    rows = rows.withColumn("w", F.expr(f"transform(w, x -> named_struct('x', x, 'c', {known}))"))
    left1, left2 = _plain("get(x.c, size(x.c) - 1)"), _plain("get(x.c, size(x.c) - 2)")
    return rows.select("row", "doc_id", "base", F.expr(f"""transform(w, x -> named_struct('start', x.x.start, 'stop', x.x.start + char_length(x.x.core), 'kind', x.x.kind,
        'strong', char_length(regexp_replace(x.x.core, '[^A-Za-z0-9]', '')) >= {ENOUGH}, 'inst', xxhash64(lower(x.x.core)), 'shape', xxhash64('S', {_shape('x.x.core')}),
        'left1', if(size(x.c) >= 1, xxhash64('L', {left1}), null), 'left2', if(size(x.c) >= 2, xxhash64('B', {left2}, {left1}), null)))""").alias("words"))


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern): a hash for every place of a left context in any text, of one word and of two, with a word after it."""
    t = _folded(f"trim(BOTH {_sql(_WHITE)} FROM t)")
    rows = docs.select(F.translate(F.col(text), MARKS, OTHER * len(MARKS)).alias("t")).where("t is not null").select(F.expr(f"split({t}, '[{_quoted(SPACE)}]+')").alias("w"))
    rows = rows.select(F.expr(f"transform(slice(w, 1, size(w) - 1), x -> {_plain('x')})").alias("w"))
    two = "zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> xxhash64('B', a, b))"
    return rows.select(F.expr(f"explode(concat(transform(w, a -> xxhash64('L', a)), {two}))").alias("pattern"))


def _confident(edges: DataFrame, scores: DataFrame, totals: DataFrame, confidence: float, support: int) -> DataFrame:
    """(pattern, kind, score) of the patterns that a round finds confident."""
    seen = edges.join(scores, "inst").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("known"), F.count("*").alias("m")).where(F.col("m") >= support)
    rows = seen.join(totals, "pattern").select("pattern", "kind", (F.col("known") / (F.col("total") + 1)).alias("score")).where(F.col("score") >= confidence)
    # a kind has more than half of the places, if any has
    return rows.groupBy("pattern").agg(F.max_by("kind", F.struct(F.col("score"), -F.col("kind"))).alias("kind"), F.max("score").alias("score"))


def learned(seen: DataFrame, docs: DataFrame, text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The confident patterns (pattern, kind, score) and the instances (inst, kind, score) after the last round. seen: a written table of read()."""
    words = seen.select(F.explode("words").alias("w")).select("w.*")
    each = F.explode(F.filter(F.array(F.struct(F.col("shape").alias("pattern"), F.lit(False).alias("context")), *(F.struct(F.col(c).alias("pattern"), F.lit(True).alias("context")) for c in ("left1", "left2"))), lambda x: x["pattern"].isNotNull())).alias("p")
    edges = materialize(words.select("inst", "strong", each).groupBy("p.pattern", "p.context", "inst").agg(F.count("*").alias("n"), F.max("strong").alias("strong")), "pattern-edges")
    best = F.max_by("kind", F.struct(F.col("n"), -F.col("kind"))).alias("kind")
    scores = materialize(words.where("kind >= 0").groupBy("inst", "kind").agg(F.count("*").alias("n")).groupBy("inst").agg(best).withColumn("score", F.lit(1.0)), "instances")
    # only these can be confident: a row for each instance of a pattern
    able = materialize(edges.where("context").groupBy("pattern").agg(F.count("*").alias("m")).where(F.col("m") >= support).select("pattern"), "contexts")
    slot = F.pmod(F.col("pattern"), F.lit(SLOTS)).cast("int").alias("slot")
    places = contexts(docs, text).withColumn("slot", slot).join(F.broadcast(able.select(slot).distinct()), "slot", "left_semi")  # SLOTS rows at most
    counts = places.groupBy("pattern").agg(F.count("*").alias("total")).join(able, "pattern", "left_semi")
    totals = materialize(edges.where("not context").groupBy("pattern").agg(F.sum("n").alias("total")).unionByName(counts), "totals")
    good = materialize(_confident(edges, scores, totals, confidence, support), "patterns")
    for _ in range(rounds - 1):
        new = edges.where("strong").join(good, "pattern").join(scores, "inst", "left_anti").groupBy("inst").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        more = materialize(scores.unionByName(new), "instances")
        grown = more.count() > scores.count()
        discard(scores)
        scores = more
        if not grown:
            break
        old, good = good, materialize(_confident(edges, scores, totals, confidence, support), "patterns")
        discard(old)
    for df in (edges, able, totals):
        discard(df)
    return good, scores


def _joined_up(name: str) -> Column:
    """The words of a sorted array, short ones that stand next to a strong one of their kind made strong."""
    near = lambda at: f"coalesce(get({name}, {at}).strong and get({name}, {at}).kind = x.kind and greatest(get({name}, {at}).start - x.stop, x.start - get({name}, {at}).stop) <= {APART}, false)"
    return F.expr(f"transform({name}, (x, i) -> named_struct('start', x.start, 'stop', x.stop, 'kind', x.kind, 'strong', x.strong or {near('i - 1')} or {near('i + 1')}))")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, base and spans, arrays of (kind, start, stop) in code points, sorted.

    base holds the fixed patterns' spans, spans also those found by pattern and instance, which overlap none of base;
    kind is its place in KINDS. Null texts count as empty. Repeated rows repeat, and count again for patterns. Other columns are left out.
    """
    seen = materialize(read(docs, doc_id, text), "candidates")
    good, scores = learned(seen, docs, text, confidence, support, rounds)
    free = seen.select("row", F.explode("words").alias("w")).select("row", "w.*").where("kind < 0")
    place = ["row", "start", "stop", "strong"]
    by_pattern = free.select(*place, F.explode(F.array("shape", "left1", "left2")).alias("pattern")).join(good, "pattern").select(*place, "kind", "score")
    by_text = free.where("strong").drop("kind").join(scores, "inst").select(*place, "kind", "score")
    found = by_pattern.unionByName(by_text).groupBy(*place).agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    more = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "strong"))).alias("a"))
    for _ in range(2):
        more = more.withColumn("a", _joined_up("a"))
    rows = seen.select("row", "doc_id", "base").join(more, "row", "left")
    own = "filter(coalesce(a, array()), x -> x.strong and not exists(base, s -> s.start < x.stop and s.stop > x.start))"
    added = f"transform({own}, x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop))"
    return rows.select("doc_id", "base", F.expr(f"if(a is null, base, array_sort(concat(base, cast({added} as {_SPAN}))))").alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop)), ',')")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS))
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
