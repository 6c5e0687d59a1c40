import re

import numpy as np

import corpus_pipeline as P
from mixlake.llm import bpe, quality, simhash
from mixlake.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    outs = [docs]
    for _, stage in P.STAGES:
        outs.append(P.materialize(stage(spark, outs[-1], SF), "test"))
    rows = [o.collect() for o in outs]
    assert len(names) == 5 and all(o.columns == docs.columns for o in outs[:5])
    judged = {r.doc_id: r.kept for r in quality.judge(docs, table(spark, SF, "labels")).collect()}
    assert sorted(r.doc_id for r in rows[1]) == sorted(i for i, k in judged.items() if k)
    for r in rows[0]:
        n, _, _, _, repeated = quality.text_counts(r.text)[:5]
        assert not (judged[r.doc_id] and (n < 50 or 100 * repeated > 50 * n))
    prints = {r.doc_id: simhash._fingerprint(r.text, 3, 42) for r in rows[1]}
    kept = {r.doc_id for r in rows[2]}
    seen, groups = dict(prints), []
    while seen:
        group, todo = [], [next(iter(seen))]
        while todo:
            i = todo.pop()
            if i in seen:
                x = seen.pop(i)
                group.append(i)
                todo += [j for j, y in seen.items() if (x ^ y).bit_count() <= 3]
        groups.append(group)
    assert kept == {min(g) for g in groups}
    texts = {r.doc_id: r.text for r in rows[3]}
    assert set(texts) == kept and all(r.n_chars == len(r.text) for r in rows[3])
    assert not any(re.search("[0-9a-f]{16}", t) for t in texts.values())
    times = {}
    for r in rows[4]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    total = sum(size.values())
    assert set(times) <= kept and max(times.values()) <= 3 and 0.9 * total <= sum(size[i] * k for i, k in times.items()) <= total
    own = bpe.encoder(bpe.default_path())
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert r.n_tokens == len(r.ids) and own.decode(np.array(r.ids).tolist()).decode() == texts[r.doc_id]
    assert P.run(spark, SF).count() == len(rows[5])
