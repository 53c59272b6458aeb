"""Operators without SQL against plain versions: fingerprints, surrogates, the parts of the toxicity model, the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("cursus.llm")
import corpus_pipeline  # noqa: E402
from cursus.llm import pii, simhash, toxicity  # noqa: E402

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = SPACE.findall(lowered(text))
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def plain_fingerprint(text):
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_the_plain_ones(spark):
    r = random.Random(11)
    words = ["The", "Éa", "x", "ümlaut", "日本", "a\x1cb", "No."]
    texts = [r.choice([" ", "\n", "\t\x0b"]).join(r.choices(words, k=r.randint(0, 30))) for _ in range(80)] + [None, "", " \r ", "one", "A b C", " ".join(r.choices(words, k=70_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: int(x["fingerprint"], 16) for x in simhash.near_duplicates(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_surrogates_against_plain_search(spark):
    import regex

    r = random.Random(12)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    people = [f"{a}@{b}.org" for a in ("al", "bo", "cy.d") for b in ("x", "y")]
    phones, cards = [digits(10) for _ in range(6)], [digits(16) for _ in range(6)]
    forms = [
        lambda: r.choice([str.upper, str.lower])(r.choice(people)),
        lambda: (lambda p: r.choice([f"({p[:3]}) {p[3:6]}-{p[6:]}", f"{p[:3]}.{p[3:6]}.{p[6:]}", f"+1 {p[:3]} {p[3:6]} {p[6:]}"]))(r.choice(phones)),
        lambda: (lambda c: r.choice([c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"]))(r.choice(cards)),
        lambda: ".".join(str(r.randint(1, 3)) for _ in range(4)), lambda: "DE44500105175407324931", lambda: "123-45-6789",
    ]
    texts = [" und ".join(r.choice(forms)() if r.random() < 0.5 else "plain words here" for _ in range(r.randint(1, 6))) for _ in range(200)] + ["no entity", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in pii.replace_pii(df, "k").collect()}
    find, pairs = regex.compile(pii.ENTITY), set()

    def canonical(e):
        d = re.sub(r"\D", "", e)
        return e.lower() if "@" in e else d[-10:] if re.match(r"[+(]|\d{3}\.\d{3}\.\d{4}", e) else e if e.count(".") == 3 else re.sub("[ -]", "", e)

    for i, text in enumerate(texts):
        before, after = find.findall(text), find.findall(got[i])
        assert find.split(text) == find.split(got[i]) and len(before) == len(after), (text, got[i])
        pairs |= {(canonical(a), canonical(b)) for a, b in zip(before, after, strict=True)}
        assert all(re.sub(r"\w", "", a) == re.sub(r"\w", "", b) for a, b in zip(before, after, strict=True) if "@" not in a and a.count(".") < 3)
    originals, surrogates = {a for a, _ in pairs}, {b for _, b in pairs}
    assert len(pairs) == len(originals) == len(surrogates) and not originals & surrogates


def test_isotonic_is_the_least_squares_fit():
    r = np.random.default_rng(5)
    x = r.normal(size=60)
    y = (x + r.normal(size=60) > 0).astype(float)
    order = np.argsort(x)
    v = y[order]
    want = [max(min(v[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert toxicity.Isotonic().fit(x, y).score(x[order]) == pytest.approx(want)


def test_boosting_takes_the_best_split():
    r = np.random.default_rng(6)
    x, y = r.normal(size=(200, 3)).round(1), r.integers(0, 2, 200).astype(float)
    one = toxicity.Boosted(trees=1, depth=1, bins=8, least=10).fit(x, y)
    g, h = y - y.mean(), np.full(200, y.mean() * (1 - y.mean()))
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
    gains = {(f, k): score(b <= k) + score(b > k) - score(b >= 0) for f in range(3) for b in [one._bin(x)[:, f]] for k in range(7) if 10 <= (b <= k).sum() <= 190}
    f, k, low, high = one.grown[0]
    b = one._bin(x)[:, f]
    assert gains[f, k] == pytest.approx(max(gains.values()))
    assert low == pytest.approx(0.15 * g[b <= k].sum() / (h[b <= k].sum() + 1)) and high == pytest.approx(0.15 * g[b > k].sum() / (h[b > k].sum() + 1))


def test_features_count_what_they_say():
    terms = {"idiot": 3.0, "foo-": 2.0}
    text = "You are an IDIOT!! really? foolish 1d1ot sooo u"
    row = toxicity.Features(terms).of_texts([text])[0]
    n = 9
    got = dict(zip(toxicity.PER_WORD, row, strict=False))
    assert got["lexicon"] == pytest.approx(1 / n) and got["stem"] == 0 and got["unmasked"] == pytest.approx(3 / n) and got["second_person"] == pytest.approx(2 / n)
    assert got["exclaimed"] == pytest.approx(2 / n) and got["asked"] == pytest.approx(1 / n) and got["stretched"] == pytest.approx(1 / n) and got["shouted"] == pytest.approx(1 / n)
    assert got["letters"] == pytest.approx(sum(map(str.isalpha, text)) / n) and row[-1] == pytest.approx(np.log1p(n))
    assert list(toxicity.Features(terms).of_texts([""])[0]) == [0] * len(row)


def plain_quality(text):
    w = SPACE.findall(text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    chars = sum(map(len, w))
    return not (
        len(w) < 10 or 100 * len(repeat) > 20 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", text or "")) > 3 * len(w) or not 2 * len(w) <= chars <= 20 * len(w)
        or 2 * (len(lines) - len(set(lines))) > len(lines) or 10 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 4 * len(w) or 10 * sum(any(map(str.isalpha, x)) for x in w) < 6 * len(w)
    )


def test_pipeline_against_plain(spark, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8)))
    texts = [" ".join(word() for _ in range(r.randint(30, 90))) for _ in range(40)]
    near = [t.replace(t.split()[20], word(), 1) for t in texts[:12]]
    rows = [(i, t) for i, t in enumerate(texts + near)]
    rows += [(100 + i, t.replace(" ", "  ")) for i, t in enumerate(texts[5:15])] + [(200, None), (201, ""), (202, "too few words"), (203, "spam spam spam " * 20)]
    rows += [(None, " ".join(word() for _ in range(40))), (None, texts[3]), (7, " ".join(word() for _ in range(50))), (300, texts[30] + " write to al@x.org or +1 415 555 2671")]
    # One row a text and a few partitions, so that ties by row never matter but for the row without id, which loses.
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    kept = [x for x in rows if plain_quality(x[1])]
    groups = {}
    for i, t in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((i, t))
    kept = [min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)) for g in groups.values()]
    sets = [set(shingles(t, 5)) for _, t in kept]
    root = list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            root[a] = min(root[b] for b in range(len(kept)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    best = {}
    for k, x in zip(root, kept, strict=True):
        best[k] = min(best.get(k, x), x, key=lambda x: (x[0] is None, x[0] or 0))
    docs = spark.createDataFrame(list(best.values()), "doc_id long, text string")
    private = [(x["doc_id"], x["text"]) for x in pii.replace_pii(docs, pii.key_of(spark)).collect()]
    plain = dict(best.values())
    assert len(best) < len(texts) + len(near) and {i for i, t in private if t != plain[i]} <= {300}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in private:
        want[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    got = Counter()
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x["doc_id"]] += x["length"]
    assert got == want


def test_no_candidate_is_left_out(spark):
    from cursus.llm import jaccard

    r = random.Random(31)
    sets = {}
    for g in range(30):  # groups around a text, near it and mostly not near each other
        base = r.sample(range(g * 1000, g * 1000 + 400), 90)
        for k in range(12):
            sets[g * 100 + k] = sorted(set(base[: r.randint(70, 90)]) | set(r.sample(range(g * 1000, g * 1000 + 400), r.randint(0, 14))))
    members = spark.createDataFrame([(0, i // 100 % 3, i) for i in sets], "band int, h long, __row long")
    roots = spark.createDataFrame([(i, i - i % 2) for i in sets if i % 100 < 2], "node long, root long")
    table = spark.createDataFrame(list(sets.items()), "__row long, set array<long>")
    links = [tuple(x) for x in jaccard.open_links(members, roots, table, 0.8, asked_rows=7, held_rows=10).collect()]
    near = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    assert links and all(near(a, b) for a, b in links)

    def joined(pairs):
        root = {i: i - i % 2 if i % 100 < 2 else i for i in sets}
        for _ in sets:
            before = dict(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            for i in sets:
                root[i] = root[root[i]]
            if root == before:
                return root

    want = [(a, b) for a in sets for b in sets if a < b and a // 100 % 3 == b // 100 % 3 and near(a, b)]
    same = [(i, i - 1) for i in sets if i % 100 == 1]
    assert joined([*links, *same]) == joined([*want, *same])
