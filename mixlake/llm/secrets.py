"""Secret scan: fixed patterns, and a battery of randomness tests for all other long tokens.

A token's encoding is inferred from its characters. Under the hypothesis that its symbols are drawn
evenly, three statistics have known moments for its length: chi-squared of the symbol counts, the
number of runs above and below the middle of the alphabet, and the serial correlation. Its p-value is
three times the least of theirs. For false discoveries, each token has a decoy: as many symbols of the
same encoding from the ordinary text around it, tested alike. In each range of lengths the least cutoff t is taken at which
(1 + decoys with p >= t) / (tokens with p >= t) is at most RATE; a range without such a cutoff reports
nothing. A token with too little text around it for a decoy counts on neither side and isn't reported.
Decoys stand for what prose would give by chance; identifiers and paths have more digits than prose, so for
them the rate is an estimate. All of this is DataFrame and SQL functions, row by row: texts are neither
shuffled nor joined.

Places are found from the gaps between matches, and tokens in a copy of the text in which fixed
patterns' spans are blotted out, so the work on a text grows with its length, and the running
sums of places with the number of its matches to the power 1.5, in steps of a few nanoseconds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.llm.shared import materialize, table, unused

#: Kinds in the order of their listing; the last is the battery's.
KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12
#: Blots out a character; texts that hold it are read as if they held the other. Both are noncharacters of Unicode.
BLOT, OTHER = "\ufdd0", "\ufdd1"
#: A long token that no blot touches.
TOKEN = rf"(?<![{BLOT}A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{20,}}+(?!{BLOT})"
#: Accepted rate of false discoveries, cutoffs that are tried, and starts of the ranges of lengths.
RATE = 0.05
CUTOFFS = (0.001, 0.003, 0.01, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
LENGTHS = (20, 24, 32, 48, 64, 128)
#: Text on either side of a token from which its decoy is drawn, in lengths of the token.
AROUND = 4
#: Encodings by the pattern that a token must match, tried in this order; their symbols, and the case to which they are folded.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", F.lower),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", F.upper),
    "letters": ("^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", F.lower),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", F.lower),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", None),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", None),
}

_SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _sums(numbers: str) -> str:
    """SQL for the running sums of an array of bigint, over groups of about the root of its length: an array grows by copying."""
    n = f"size({numbers})"
    b = f"cast(ceil(sqrt({n})) as int)"
    grow = lambda values, begin: f"aggregate({values}, cast(array({begin}) as array<bigint>), (a, x) -> array_append(a, element_at(a, -1) + x))"
    groups = f"transform(sequence(0, cast(({n} - 1) div {b} as int)), g -> slice({numbers}, g * {b} + 1, {b}))"
    begins = grow(f"transform({groups}, g -> aggregate(g, 0L, (a, x) -> a + x))", "0L")
    return f"if({n} = 0, cast(array() as array<bigint>), flatten(zip_with({groups}, {begins}, (g, s) -> if(g is null, cast(array() as array<bigint>), slice({grow('g', 's')}, 2, size(g))))))"


def _find(rows: DataFrame, text: str, pattern: str, name: str, test: str | None = None) -> DataFrame:
    """Adds `name`, the (start, stop, hit) of each of the pattern's matches in code points, and gaps of that name, the texts between them.

    test: SQL of a condition on `hit`; other matches count as gaps' ends all the same, but have a null hit.
    """
    p, kept = _quoted(pattern), rows.columns
    rows = rows.withColumn("_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = rows.withColumn(f"{name}_gaps", F.when(F.size("_hits") > 0, F.expr(f"split({text}, '{p}', -1)")).otherwise(F.array(F.col(text))))
    rows = rows.withColumn("_steps", F.expr(f"zip_with(_hits, slice({name}_gaps, 1, size(_hits)), (h, g) -> cast(char_length(g) + char_length(h) as bigint))"))
    rows = rows.withColumn("_ends", F.expr(_sums("_steps")))
    hit = f"if({test.format(hit='h')}, h, null)" if test else "h"
    return rows.select(*kept, f"{name}_gaps", F.expr(f"zip_with(_hits, _ends, (h, e) -> struct(e - char_length(h) as start, e as stop, {hit} as hit, h as whole))").alias(name))


def _blotted(name: str) -> Column:
    """The text of a search with its hits blotted out."""
    return F.expr(f"array_join(zip_with({name}_gaps, {name}, (g, h) -> concat(g, coalesce(if(h.hit is null, h.whole, repeat('{BLOT}', char_length(h.hit))), ''))), '')")


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by a rational approximation with error under 1e-7; smaller z give a half."""
    z = F.greatest(z, F.lit(0.0))
    t = 1 / (1 + 0.3275911 * z / math.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-z * z / 2)


def _bare(token: Column) -> Column:
    return F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")


def _encoding(bare: Column) -> Column:
    out = F.lit("base64")
    for name, (pattern, _, _) in reversed(list(ENCODINGS.items())[:-1]):
        out = F.when(bare.rlike(pattern), name).otherwise(out)
    return out


def _symbols(text: Column, encoding: Column) -> Column:
    """The symbols of an encoding in a text, folded to its case."""
    out = F.lit(None).cast("string")
    for name, (_, letters, fold) in ENCODINGS.items():
        folded = fold(text) if fold else text
        out = F.when(encoding == name, F.regexp_replace(folded, f"[^{letters}]", "")).otherwise(out)
    return out


def _tested(tokens: str, bare: str, p: str) -> list[tuple[str, Column]]:
    """Steps that give each struct of the array `tokens` a field p from its fields encoding and `bare`, its folded symbols."""
    abc = F.create_map(*(F.lit(x) for name, (_, letters, _) in ENCODINGS.items() for x in (name, letters)))

    def add(name: str, value) -> tuple[str, Column]:
        return tokens, F.transform(tokens, lambda c: c.withField(name, value(c)))

    total = lambda values, f: F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))

    def p_value(c: Column) -> Column:
        n, size, high = c["n"], c["size"], c["high"]
        chi = (c["squares"] * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        both = 2 * high * (n - high)
        runs = F.try_divide(c["runs"] - 1 - both / n, F.sqrt(F.greatest(F.try_divide(both * (both - n), n * n * (n - 1)), F.lit(0.0))))
        serial = (F.try_divide(c["cov"], c["var"]) + 1 / n) * F.sqrt(n)
        least = F.least(_upper_tail(chi), F.coalesce(2 * _upper_tail(F.abs(runs)), F.lit(1.0)), F.coalesce(2 * _upper_tail(F.abs(serial)), F.lit(1.0)))
        return F.when(n >= 2, F.least(3 * least, F.lit(1.0)))

    return [
        add("n", lambda c: F.char_length(c[bare]).cast("double")),
        add("abc", lambda c: F.element_at(abc, c["encoding"])),
        add("size", lambda c: F.char_length(c["abc"]).cast("double")),
        add("chars", lambda c: F.split(c[bare], "")),
        add("v", lambda c: F.transform(c["chars"], lambda x: (F.instr(c["abc"], x) - 1).cast("double"))),
        add("squares", lambda c: F.aggregate(F.array_distinct(c["chars"]), F.lit(0.0), lambda a, x: a + F.pow(F.char_length(c[bare]) - F.char_length(F.replace(c[bare], x, F.lit(""))), F.lit(2)))),
        add("mean", lambda c: total(c["v"], lambda x: x) / c["n"]),
        add("pairs", lambda c: F.when(c["n"] >= 2, F.zip_with(F.slice(c["v"], 1, F.size(c["v"]) - 1), F.slice(c["v"], 2, F.size(c["v"]) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))),
        add("runs", lambda c: total(c["pairs"], lambda q: ((q["x"] >= c["size"] / 2) != (q["y"] >= c["size"] / 2)).cast("double")) + 1),
        add("high", lambda c: F.size(F.filter(c["v"], lambda x: x >= c["size"] / 2)).cast("double")),
        add("var", lambda c: total(c["v"], lambda x: (x - c["mean"]) * (x - c["mean"]))),
        add("cov", lambda c: total(c["pairs"], lambda q: (q["x"] - c["mean"]) * (q["y"] - c["mean"]))),
        (tokens, F.transform(tokens, lambda c: c.withField(p, p_value(c)).dropFields("n", "abc", "size", "chars", "v", "squares", "mean", "pairs", "runs", "high", "var", "cov"))),
    ]


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds encoding and p (double): how well the token agrees with evenly drawn symbols.

    Null tokens and those of under two symbols get a null p. Tokens of one symbol only have no runs
    or correlation to test; they fail the chi-squared test.
    """
    kept, one = tokens.columns, unused(tokens, "_one")
    rows = tokens.withColumn(one, F.array(F.struct(_bare(F.col(token)).alias("text"), _encoding(_bare(F.col(token))).alias("encoding"))))
    rows = rows.withColumn(one, F.transform(one, lambda c: c.withField("bare", _symbols(c["text"], c["encoding"]))))
    for name, step in _tested(one, "bare", "p"):
        rows = rows.withColumn(name, step)
    return rows.select(*kept, F.col(one)[0]["encoding"].alias("encoding"), F.col(one)[0]["p"].alias("p"))


def _range(length: Column) -> Column:
    return sum((length >= x).cast("int") for x in LENGTHS)


def _rung(p: Column) -> Column:
    return sum((p >= x).cast("int") for x in CUTOFFS)


def cutoffs(tested: DataFrame, rate: float = RATE) -> dict[int, float]:
    """The cutoff of each range of lengths. tested: range, p, decoy_p over all tokens, those without both left out; its counts by range and rung reach the driver."""
    both = tested.where("p is not null and decoy_p is not null")
    sides = both.select("range", F.explode(F.array(F.struct(F.lit(False).alias("decoy"), F.col("p").alias("p")), F.struct(F.lit(True).alias("decoy"), F.col("decoy_p").alias("p")))).alias("x"))
    counts = {(r["range"], r.decoy, r.rung): r.n for r in sides.groupBy("range", "x.decoy", _rung(F.col("x.p")).alias("rung")).agg(F.count("*").alias("n")).collect()}
    found = {}
    for k in range(1, len(LENGTHS) + 1):
        over = lambda decoy, i, k=k: sum(counts.get((k, decoy, r), 0) for r in range(i + 1, len(CUTOFFS) + 1))
        for i, t in enumerate(CUTOFFS):
            if over(False, i) and (1 + over(True, i)) / over(False, i) <= rate:
                found[k] = t
                break
    return found


def read(rows: DataFrame, text: str) -> DataFrame:
    """rows with base (spans of the fixed patterns, sorted), loose, all other long tokens (start, stop, token, p, decoy_p, range), and between, the texts around those, where base is blotted out.

    `text` must have no nulls; columns named base, loose and between, and names with a leading `_s`, must be free.
    """
    kept = rows.columns
    rows = rows.withColumn("_st", F.translate(F.col(text), BLOT, OTHER))
    p = _quoted(ASSIGN)
    rows = _find(rows, "_st", ASSIGN, "_sa", f"char_length(regexp_extract({{hit}}, '{p}', 1)) >= {ASSIGNED}")
    rows = _find(_find(rows, "_st", ACCESS, "_sk"), "_st", HEX, "_sx")
    base = f"""array_sort(concat({', '.join(f"transform(filter(_s{n}, s -> s.hit is not null), s -> struct(s.start as start, {k} as kind, s.stop as stop))" for k, n in enumerate('akx'))}))"""
    rows = rows.select(*kept, F.expr(f"cast({base} as {_SPAN})").alias("base"), _blotted("_sa").alias("_sb"))
    # what remains of an overlapping hit touches a blot, so no token is taken there
    rows = _find(rows, "_sb", f"{ACCESS}|{HEX}", "_sc").select(*kept, "base", _blotted("_sc").alias("_sd"))
    rows = _find(rows, "_sd", TOKEN, "_se")
    near = "zip_with(slice(_se_gaps, 1, size(_se)), slice(_se_gaps, 2, size(_se)), (a, b) -> named_struct('a', a, 'b', b))"
    both = f"""zip_with(_se, {near}, (c, g) -> struct(c.start as start, c.stop as stop, c.hit as token,
        concat(right(g.a, {AROUND} * char_length(c.hit)), left(g.b, {AROUND} * char_length(c.hit))) as around))"""
    rows = rows.select(*kept, "base", F.col("_se_gaps").alias("between"), F.expr(both).alias("loose"))
    rows = rows.withColumn("loose", F.transform("loose", lambda c: c.withField("bare", _bare(c["token"]))))
    rows = rows.withColumn("loose", F.transform("loose", lambda c: c.withField("encoding", _encoding(c["bare"])).withField("range", _range(F.char_length(c["token"])))))
    rows = rows.withColumn("loose", F.transform("loose", lambda c: c.withField("decoy", F.left(_symbols(c["around"], c["encoding"]), F.char_length(c["bare"]))).withField("bare", _symbols(c["bare"], c["encoding"]))))
    for name, step in _tested("loose", "bare", "p"):
        rows = rows.withColumn(name, step)
    rows = rows.withColumn("loose", F.transform("loose", lambda c: c.withField("decoy", F.when(F.char_length(c["decoy"]) == F.char_length(c["bare"]), c["decoy"]))))
    for name, step in _tested("loose", "decoy", "decoy_p"):
        rows = rows.withColumn(name, step)
    return rows.withColumn("loose", F.transform("loose", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["token"].alias("token"), c["p"].alias("p"), c["decoy_p"].alias("decoy_p"), c["range"].alias("range"))))


def _passes(found: dict[int, float]):
    """Whether a token of loose is reported under the cutoffs by range."""
    if not found:
        return lambda c: F.lit(False)
    own = F.create_map(*(F.lit(x) for pair in found.items() for x in pair))
    return lambda c: F.coalesce(c["decoy_p"].isNotNull() & (c["p"] >= F.try_element_at(own, c["range"])), F.lit(False))


def _cutoffs_of(rows: DataFrame, rate: float) -> dict[int, float]:
    return cutoffs(rows.where(F.size("loose") > 0).select(F.explode("loose").alias("x")).select("x.range", "x.p", "x.decoy_p"), rate)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of docs: doc_id, base and spans, arrays of (start, kind, stop).

    base holds the fixed patterns' spans, spans also the battery's, which don't overlap those; kind is
    its place in KINDS; both are sorted by start, then kind. Null texts count as empty. Rows are
    independent but for the cutoffs: repeated ones repeat. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    slim = F.transform("loose", lambda c: c.dropFields("token"))
    found = materialize(read(rows, "t").select("doc_id", "base", slim.alias("loose")), "spans")
    more = F.transform(F.filter("loose", _passes(_cutoffs_of(found, rate))), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more.cast(_SPAN))).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop)), ',')")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """docs with every span of its text replaced by `mark`; spans that overlap or touch share one. All columns stay; n_chars is not updated here.

    Null texts stay null; BLOT becomes OTHER. The rows are written once with their texts cut at the long
    tokens, as the cutoffs need all of them, and then joined again; nothing is shuffled.
    """
    taken = {n: unused(docs, f"_kept_{n}") for n in docs.columns if n.lower() in ("base", "loose", "between") or n.lower().startswith("_s")}
    clear = unused(docs, "_clear")
    rows = docs.withColumnsRenamed(taken)
    held = taken.get(text, text)
    rows = rows.withColumn(clear, F.coalesce(F.col(held), F.lit(""))).withColumn(held, F.col(held).isNull())
    rows = materialize(read(rows, clear).drop(clear, "base"), "spans")
    passes = _passes(_cutoffs_of(rows, rate))
    hits = F.transform("loose", lambda c: F.when(passes(c), F.lit(BLOT)).otherwise(c["token"]))
    whole = F.array_join(F.zip_with("between", hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
    whole = F.regexp_replace(whole, F.lit(f"{BLOT}+"), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$")))
    rows = rows.withColumn(held, F.when(~F.col(held), whole)).drop("loose", "between")
    return rows.withColumnsRenamed({b: a for a, b in taken.items()}).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3]))
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
