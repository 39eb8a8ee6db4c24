import random

import numpy as np

from gridlake.llm import licenses as li


def test_alignment_is_the_longest_common_subsequence_of_the_band():
    rng = random.Random(1)
    for _ in range(500):
        t = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))]
        r = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 20))]
        band = rng.randint(0, 6)
        table = np.zeros((len(t) + 1, len(r) + 1), int)
        for i in range(len(t)):
            for j in range(len(r)):
                own = table[i, j] + 1 if t[i] == r[j] and i <= j <= i + 2 * band else 0
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], own)
        pairs = li.aligned_words(t, r, band)
        assert len(pairs) == table[-1, -1]
        assert all(t[i] == r[j] and i <= j <= i + 2 * band for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_winnowing_keeps_the_least_of_every_window():
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 60)))
        padded = data.ljust(li.GRAM)
        codes = [int(li.winnow(padded[k : k + li.GRAM])[0][0]) for k in range(len(padded) - li.GRAM + 1)]
        wanted = set()
        for at in range(max(1, len(codes) - li.WINDOW + 1)):
            window = codes[at : at + li.WINDOW]
            wanted |= {at + k for k, c in enumerate(window) if c == min(window)}
        assert set(li.winnow(data)[1].tolist()) == wanted


def test_templates_are_found_with_their_spans(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice("er tion the of und des que".split()) + str(rng.randrange(50)) for _ in range(n))
    rows, wanted = [], set()
    for k, (name, text) in enumerate(sorted(li.TEMPLATES.items()) * 3):
        words = text.split()
        if k >= len(li.TEMPLATES) and len(words) > 30:  # an edit in every fortieth word, or a cut-off beginning
            words = [w if j % 40 else f"x{j}" for j, w in enumerate(words)] if k < 2 * len(li.TEMPLATES) else words[len(words) // 8 :]
        rows.append((k, f"{filler(30)}é\n{' '.join(words)}\n{filler(300)}"))
        wanted.add((k, name))
    rows += [(900, None), (901, ""), (902, filler(2000)), (None, "All  rights\nRESERVED"), (903, "license released under rights")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", li.F.lit(1)).repartition(2)
    found = li.scan(docs).collect()
    texts = dict(rows)
    assert wanted | {(None, "all-rights-reserved")} <= {(r.doc_id, r.template) for r in found}
    assert not {r.doc_id for r in found} & {900, 901, 902, 903}
    for r in found:
        inside = " ".join(texts[r.doc_id][s.start : s.end] for s in r.spans)
        assert len(li.words(inside)) == r.n_matched
        assert li.COVERAGE <= r.coverage <= 1
    assert li.scan(docs.limit(0)).count() == 0
    assert li.scan(docs, {"empty": "?!"}).count() == 0


def test_templates_in_parts_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, li.TEMPLATES["mit"] + " All rights reserved. All rights reserved.")], "doc_id long, text string")
    whole = sorted(map(str, li.scan(docs).collect()))
    monkeypatch.setattr(li, "MOST_WORDS", 50)
    assert sorted(map(str, li.scan(docs).collect())) == whole
    assert len(whole) == 3


def test_common_licenses_are_found_whole():
    wanted = "bsd-2-clause bsd-3-clause lgpl-2.1 lgpl-3.0 mpl-2.0 unlicense cc0-1.0 apache-2.0 gpl-2.0 gpl-3.0 boost-1.0 agpl-3.0-header isc".split()
    index = li.TemplateIndex(sorted(li.TEMPLATES.items()), li.COVERAGE)
    for name in wanted:
        text = "Some words before. " + li.TEMPLATES[name]
        found = {n: (share, spans) for n, share, _, spans in index.matches(text)}
        assert found[name][0] == 1
    assert li.TEMPLATES["isc"].endswith("PERFORMANCE OF THIS SOFTWARE.")
    assert "You should have received a copy" in li.TEMPLATES["gpl-3.0-header"]
    # A text is not taken for another license whose words it nearly holds.
    for name in ("bsd-2-clause", "bsd-3-clause", "gpl-3.0-header", "agpl-3.0-header", "gpl-2.0-header", "lgpl-2.1-header"):
        assert {n for n, *_ in index.matches(li.TEMPLATES[name])} == {name}
