import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

from mixlake.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, h):
    d = re.sub("[^0-9]", "", h)
    if kind == "ip":
        return all(int(p) <= 255 for p in h.split("."))
    return {"email": True, "card": 13 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]


def base_of(text):
    return sorted((k, m.start(), m.end()) for k, name in enumerate(P.KINDS) for m in re.finditer(PLAIN[name], text) if passes(name, m.group()))


def seeds_of(text):
    """Matches of any fixed pattern, leftmost first and none over another, with their kinds."""
    for m in re.finditer("|".join(f"(?:{'(?<![A-Za-z0-9._%+-])' * (k == 'email')}{PLAIN[k]})" for k in ("email", "phone", "ip", "card")), text):
        h = m.group()
        kind = "email" if "@" in h else "phone" if h[0] == "+" else "ip" if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", h) else "card"
        if passes(kind, h):
            yield m.start(), m.end(), P.KINDS.index(kind)


def folded(w):
    return w.translate({**{c: c + 32 for c in range(65, 91)}, **{c: 57 for c in range(48, 57)}})


def shape(core):
    marks = "".join("\x01" if unicodedata.category(c) == "Ll" else "\x02" if unicodedata.category(c) == "Lu" else c for c in core)
    out = re.sub("\x02+", "A", re.sub("\x01+", "a", marks))
    return out.translate({c: 57 for c in range(48, 57)})


def words_of(text):
    """(start, stop, kind, strong, inst, patterns) of the candidates of a text."""
    seeds, out, previous = list(seeds_of(text)), [], None
    for m in WORD.finditer(text):
        touched = [k for a, b, k in seeds if a < m.end() and b > m.start()]
        if not touched and not re.search("[0-9@]", m.group()):
            continue
        gap = ("" if previous is None else previous.group()) + text[0 if previous is None else previous.end() : m.start()]
        left = [x for x in re.split(r"[\x20\x09-\x0D]+", folded(gap[-P.BEFORE :].strip(" \t\n\x0b\x0c\r")))]
        left = left[1:] if len(gap) > P.BEFORE else [x for x in left if x]
        previous = m
        opened = m.group().lstrip(P.OPENS)
        core = opened.rstrip(P.CLOSES)
        if not core:
            continue
        start = m.end() - len(opened)
        patterns = [("S", shape(core))]
        if left:
            patterns.append(("L", left[-1][-P.TAIL :]))
        if len(left) >= 2:
            patterns.append(("B", left[-2][-P.TAIL :], left[-1][-P.TAIL :]))
        strong = len(re.sub("[^A-Za-z0-9]", "", core)) >= P.ENOUGH
        out.append((start, start + len(core), min(touched) if touched else -1, strong, core.lower(), patterns))
    return out


def brute(docs):
    """(base, spans) of each text."""
    texts = [t or "" for _, t in docs]
    seen = [words_of(t) for t in texts]
    places = Counter()
    for t in texts:
        w = [folded(x)[-P.TAIL :] for x in WORD.findall(t)]
        places.update(("L", a) for a in w[:-1])
        places.update(("B", a, b) for a, b in zip(w, w[1:-1], strict=False))
    edges, strong, label = Counter(), {}, defaultdict(Counter)
    for words in seen:
        for _, _, kind, s, inst, patterns in words:
            strong[inst] = s
            if kind >= 0:
                label[inst][kind] += 1
            for p in patterns:
                edges[p, inst] += 1
                if p[0] == "S":
                    places[p] += 1
    scores = {i: (min(c, key=lambda k: (-c[k], k)), 1.0) for i, c in label.items()}

    def confident():
        known, support = Counter(), Counter()
        for (p, i), n in edges.items():
            if i in scores:
                known[p, scores[i][0]] += n * scores[i][1]
                support[p, scores[i][0]] += 1
        return {p: (k, v / (places[p] + 1)) for (p, k), v in known.items() if support[p, k] >= P.SUPPORT and v / (places[p] + 1) >= P.CONFIDENCE}

    good = confident()
    for _ in range(P.ROUNDS - 1):
        new = {}
        for p, i in edges:
            if strong[i] and p in good and i not in scores:
                new[i] = max(new.get(i, (0, 0)), (good[p][1], -good[p][0]))
        if not new:
            break
        scores.update({i: (-k, s) for i, (s, k) in new.items()})
        good = confident()
    out = []
    for text, words in zip(texts, seen, strict=True):
        found = []
        for start, stop, kind, s, inst, patterns in words:
            best = [good[p] for p in patterns if p in good] + ([scores[inst]] if s and inst in scores else [])
            if kind < 0 and best:
                found.append([start, stop, max(best, key=lambda x: (x[1], -x[0]))[0], s])
        for _ in range(2):
            near = lambda a, b: b[3] and a[2] == b[2] and max(b[0] - a[1], a[0] - b[1]) <= P.APART
            found = [[a, b, k, s or any(near(found[i], found[j]) for j in (i - 1, i + 1) if 0 <= j < len(found))] for i, (a, b, k, s) in enumerate(found)]
        base = base_of(text)
        out.append((base, sorted(base + [(k, a, b) for a, b, k, s in found if s and not any(x < b and y > a for _, x, y in base)])))
    return out


def run(spark, docs):
    df = spark.createDataFrame([(t, i, "x", n) for n, (i, t) in enumerate(docs)], "text string, doc_id long, base string, ROW int").repartition(3)
    got = P.scan(df).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in got)


def agrees(spark, docs):
    want = brute(docs)
    got = run(spark, docs)
    assert got == sorted((-1 if i is None else i, b, s) for (i, _), (b, s) in zip(docs, want, strict=True))
    return got


def card(r):
    d = "4" + "".join(r.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_equals_brute_force(spark):
    r, docs = random.Random(8), []
    words = "the of and Über mail reach call at me is était a x7 see".split()
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(0, 9999):04d}"
    for i in range(160):
        text = [r.choice(words) for _ in range(r.randint(20, 40))]
        for _ in range(3):
            one = r.choice([card(r), phone(), f"{r.choice('abcde')}x.{r.randint(10, 99)}@mail{r.randint(0, 9)}.example.com", ".".join(str(r.randint(0, 255)) for _ in range(4)), f"e-mail: {r.choice('pqrst')}{r.randint(0, 99)}@site.org,", f"v{r.randint(0, 9)}.{r.randint(0, 99)}"])
            text.insert(r.randint(0, len(text)), one)
        docs.append((i, " ".join(text).replace(" see ", "\n")))
    docs += [(200, "write to e-mail: john7(at)site or e-mail: maria22[at]site.org now"), (201, "call +1 (250) 555-1234 4111111111111111 today"), (202, "the number 4111 1111 1111 1112 is none"), (203, docs[3][1]), (3, docs[3][1])]
    got = agrees(spark, docs)
    added = {i: [s for s in spans if s not in base] for i, base, spans in got}
    assert [docs[160][1][a:b] for _, a, b in added[200]] == ["john7(at)site", "maria22[at]site.org"]  # never seen, by the word before them
    assert {docs[161][1][a:b] for _, a, b in added[201]} >= {"555-1234", "4111111111111111"}  # as one they fail both patterns
    assert added[202] == []


def test_fixed_patterns_match_their_plain_forms(spark):
    r = random.Random(9)
    docs = [(i, "".join(r.choice("a1@.-+ (2)9 %_\n") for _ in range(r.randint(0, 60)))) for i in range(600)]
    docs += [(700 + i, "".join(r.choice(["12", ".", "255", "256", "00", " ", "a", "4111111111111111", "-", "+1", "@b.c", "é", "\U0001f600"]) for _ in range(30))) for i in range(300)]
    agrees(spark, docs)


def test_edges(spark):
    assert run(spark, []) == []
    docs = [(None, "a@b.co \ufdd0 c@d.eu"), (1, None), (2, ""), (3, "\ufdd1\ufdd4 @"), (3, "\ufdd1\ufdd4 @"), (4, "  \t 1.2.3.4  \x0b +49 (30) 1234567 "), (5, "w" * 300 + " " * 300 + "x9 " + "9" * 500 + "@a.b")]
    got = run(spark, docs)
    assert [(i, b) for i, b, _ in got] == sorted((-1 if i is None else i, base_of(t or "")) for i, t in docs)


def test_long_texts_take_time_in_proportion(spark):
    docs = [(1, "a" * 400_000), (2, "1" * 400_000), (3, "a@b" + ".c" * 200_000), (4, "+1" + " " * 400_000), (5, "a.b-" * 100_000), (6, "1." * 200_000), (7, "x1 " * 60_000), (8, ")" * 400_000 + "1")]
    got = {i: base for i, base, _ in run(spark, docs)}
    assert got[3] == [(0, 0, 400_003)] and not got[1] and not got[5]


def test_query_columns(spark, tmp_path):
    docs = [(1, "mail a@b.co or 1.2.3.4"), (2, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in P.query(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[1] == {"doc_id": 1, "n_email": 1, "n_ip": 1, "n_card": 0, "n_phone": 0, "base_sha256": digest("email:5:11,ip:15:22"), "spans": "email:5:11,ip:15:22"}
    assert rows[2]["base_sha256"] == digest("") and rows[2]["spans"] == ""
