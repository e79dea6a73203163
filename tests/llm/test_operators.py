"""Corpus operators on small fixtures: brute-force versions, SQL, and the defined cases."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from rillstone.llm import decontamination, language, media, mixing, page_text, personal_data, quality, queries, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size int, words string"
ODD = [
    (1, None, "en", "a", None, 0.1, 1, 1, "x"),
    (2, "", None, None, 0, None, None, None, None),
    (3, "the same text, twice: mail me@site.example.com or +1 (555) 123-4567", "en", "a", 5, 0.5, 2, 2, "y"),
    (3, "the same text, twice: mail me@site.example.com or +1 (555) 123-4567", "en", "a", 5, 0.5, 2, 2, "y"),
    (4, "word " * 30000 + "10.0.0.1 4111 1111 1111 1111", "de", None, 9, 0.5, 2, 2, "z"),
    (None, "no id here", "fr", "b", 1, 0.2, 3, 3, "w"),
]
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    pd.testing.assert_frame_equal(ours[order].sort_values("doc_id", ignore_index=True), theirs[order].sort_values("doc_id", ignore_index=True), check_dtype=False)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    found = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and doubled % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if good():
                found.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_personal_data_equals_brute_force(spark, texts):
    got = personal_data.query(spark, SF).toPandas().set_index("doc_id")
    for i, text in texts.items():
        assert got.base_sha256[i] == hashlib.sha256(plain_spans(text or "").encode()).hexdigest()


def test_simhash_equals_brute_force(spark, texts):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = {i: plain(t) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    got = simhash.query(spark, SF).toPandas().set_index("doc_id")
    assert {i: f"{v:016x}" for i, v in prints.items()} == got.fingerprint.to_dict()
    assert {i: top(i) for i in prints} == got.component_id.to_dict()


def test_sharding_equals_published_loop(spark, texts):
    def jump(key, n):
        b, j = -1, 0
        key %= 2**64
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    got = sharding.query(spark, SF).toPandas()
    for r in got.itertuples():
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(text) + 8, zlib.crc32(text), jump(r.doc_id, 24), jump(r.doc_id, 25))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_media_payload(spark, texts):
    got = media.query(spark, SF).toPandas().set_index("doc_id")
    for i, text in texts.items():
        raw = (text or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert got.payload_sha256[i] == hashlib.sha256(raw).hexdigest() and got.tail_crc32[i] == zlib.crc32(raw[-64:])


def test_language_against_declared(spark):
    got = language.query(spark, "/root/testdata/sf0.001").toPandas()
    assert (got.lang == got.declared).mean() > 0.95
    assert (got.text_lang == got.declared).mean() > 0.95


def test_trigram_slots_equal_brute_force():
    assert len(language.trigram_slots("Ab, c")) == 4  # " ab", "ab ", "b c", " c "
    assert len(language.trigram_slots("")) == 0
    assert np.array_equal(language.trigram_slots("AB!c"), language.trigram_slots("ab c"))


@pytest.mark.parametrize("name,label,floor", [("op1_quality", "quality", 0.9), ("op4_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, floor):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out & got[label].notna()]
    assert (held.predicted == held[label]).mean() >= floor


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    bench = spark.createDataFrame([(1, "the same text twice"), (2, None)], BENCH)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, toxic = quality.fit(docs, labels), toxicity.fit(docs, labels)
    for frame in (docs, docs.limit(0)):
        n = frame.count()
        assert personal_data.report(frame).count() == n
        assert decontamination.report(frame, bench).count() == n
        assert mixing.mix(frame).count() == n
        assert simhash.classes(frame).count() == n
        assert sharding.place(frame).count() == n
        assert quality.scored(frame, model).count() == n
        assert toxicity.scored(frame, toxic, keep=("doc_id", "score", "words")).columns == ["doc_id", "words", "score", "predicted"]
        assert toxicity.scored(frame, toxic).count() == n
        assert media.store(frame, media="words").select(media.read(F.col("words")).alias("r")).count() == n
    assert decontamination.report(docs, bench).where("contaminated").select("doc_id", "n_hit").distinct().collect()[0].asDict() == {"doc_id": 3, "n_hit": 4}


#: Names that the operators might use themselves.
CLASHES = ["score", "predicted", "s_digit", "_words", "_id", "_hash", "_key", "_doc", "_score", "_text", "size", "taken", "shard", "_g", "_row", "spans", "clean_words", "media", "_no", "fp", "node"]


def test_columns_of_any_name_pass_through(spark):
    rows = [(i, f"document number {'abcdefgh'[i]} is one of eight that differ {'xyzuvwqk'[i] * 3} from all", "a", *[f"{c}{i}" for c in CLASHES]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    bench = spark.createDataFrame([(1, rows[3][1])], BENCH)
    model = quality.RuleModel(1.0, ())
    same = lambda got, skip=(): {r.doc_id: tuple(r[c] for c in docs.columns if c not in skip) for r in got.collect()}
    want = lambda skip=(): {r[0]: tuple(v for c, v in zip(docs.columns, r) if c not in skip) for r in rows}
    assert same(quality.accepted(docs, model)) == want()
    assert same(quality.scored(docs, model), ("score", "predicted")) == want(("score", "predicted"))
    assert same(simhash.keep_one(docs)) == want()
    assert same(decontamination.remove(docs, bench)) == {i: r for i, r in want().items() if i != 3}
    assert same(decontamination.cut_spans(docs, bench), ("clean_words",)) == want(("clean_words",))
    assert same(mixing.apply_mix(docs, weights=(1,), max_epochs=1)) == want()
    assert same(sharding.with_shards(docs), ("shard",)) == want(("shard",))
    assert same(media.store(docs), ("media",)) == want(("media",))


def test_shards_of_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("a-1", "x"), ("a-2", "x"), (None, "x"), ("a-1", "y")], "doc_id string, text string")
    got = {(r.doc_id, r.text): r for r in sharding.with_shards(docs).collect()}
    assert got["a-1", "x"].shard == got["a-1", "y"].shard and all(0 <= r.shard < 24 for r in got.values())
    assert sorted(r.shard for r in sharding.place(docs).collect()) == sorted(r.shard for r in got.values())


def test_mix_applied_takes_what_the_mix_says(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) if i % 7 else None, " ".join(f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 40))), "abc"[i % 3] if i % 5 else None, 0) for i in range(200)] + [(3, "one two three", "a", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = mixing.mix(docs).groupBy().agg(F.sum("taken")).first()[0]
    out = mixing.apply_mix(docs).collect()
    assert sum(len(r.text.split()) for r in out) == taken and all(r.n_chars == len(r.text) for r in out)
    assert sorted(map(str, mixing.apply_mix(docs).collect())) == sorted(map(str, out))


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = decontamination.report(docs, bench).toPandas().sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_ROWS", 0)
    pd.testing.assert_frame_equal(decontamination.report(docs, bench).toPandas().sort_values("doc_id", ignore_index=True), want)
    assert sorted(r.doc_id for r in decontamination.remove(docs, bench).collect()) == sorted(want.doc_id[~want.contaminated])


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "not a url", ""), (2, "http://a.example.com/", "<p>" + "the " * 20000)], "page_id long, url string, html string")
    docs = spark.createDataFrame([("the and of", "en"), ("der die das", "de"), (None, "de"), ("x", None)], "text string, lang string")
    got = language.identify(pages, docs).toPandas()
    assert len(got) == 3 and got[got.page_id == 2].lang.item() == "en"
    assert language.identify(pages, docs.limit(0)).toPandas().lang.isna().all()
    assert language.identify(pages.limit(0), docs).count() == 0


def test_simhash_keeps_texts_of_null_and_repeated_ids(spark):
    far = ["the quick brown fox jumps over the lazy dog", "many rivers run slowly to a cold northern sea", "seven old clocks strike noon in an empty hall"]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (5, far[2]), (5, far[0] + " again and again until night"), (7, far[2])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, far[0]), (0, far[1]), (5, far[2]), (5, rows[4][1])])


def test_near_copies_of_five_word_similarity_are_one(spark):
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for base in range(40):
        words = [f"w{base}x{i}" for i in rng.integers(0, 9000, 300)]
        rows.append((100 * base, " ".join(words)))
        want.add(100 * base)
        for k in range(1, 9):  # five edited words cost at most 25 of 296 shingles: similarity 0.84 with the base
            copy = list(words)
            for at in rng.choice(300, 5, replace=False):
                copy[at] = f"new{base}_{k}_{at}"
            rows.append((100 * base + k, " ".join(copy)))
        half = words[:150] + [f"other{base}_{i}" for i in range(150)]
        rows.append((100 * base + 50, " ".join(half)))
        want.add(100 * base + 50)
    rows += [(9001, ""), (9002, None), (9003, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want | {9001}


def test_decontamination_decides_each_row(spark):
    rows = [(None, "clean words without an id"), (None, "see the same text twice here"), (7, "the same text twice"), (7, "a clean text of that id"), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the same text twice")], BENCH)
    assert sorted(map(str, map(tuple, decontamination.remove(docs, bench).collect()))) == sorted(map(str, [rows[0], rows[3], rows[4], rows[5]]))
    cut = {(r.doc_id, r.text): r.clean_words for r in decontamination.cut_spans(docs, bench).collect()}
    assert len(cut) == 6 and cut[rows[0]] == rows[0][1].split() and cut[rows[1]] == ["see", "here"] and cut[rows[2]] == [] and cut[rows[3]] == rows[3][1].split()


def test_toxicity_counts_each_different_text(spark):
    costs = np.zeros((28, 28, 28)).tolist()
    texts = [f"the common words of all texts and number {'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}x" for k in range(100)]
    (out,) = toxicity._features(costs)([pd.DataFrame({"text": [*texts, texts[0]], "toxic": 1})])
    assert out.sketch.nunique() == 100


def test_page_text_goes_on_after_marked_links_and_unclosed_elements():
    shown = lambda page: [b["text"] for b in page_text.blocks(page) if not b["beside"]]
    assert shown('<body><a class="skip-link" href="#m">Skip</a><main><article><p>All of it.</p></article></main>') == ["All of it."]
    assert shown('<p>text <a class="share">Share</a> more text</p><p>end</p>') == ["text", "more text", "end"]
    assert shown('<p>text <a href="x">unclosed <a class="share">Share</a> more</p>') == ["text unclosed", "more"]
    assert page_text.blocks('<p>one <a class="share">Share <a href="x">two</a> three</p>')[-1]["beside"] is False
    for tag in ("button", "select", "iframe", "canvas", "video", "audio", "template"):
        assert shown(f"<p>before</p><{tag}><p>after</p>")[-1] == "after"
    assert shown("<p>before</p><script>var x = '<p>after</p>'") == ["before"]


def test_toxicity_restores_every_disguise(spark):
    docs = spark.createDataFrame([("the idiot has an ass and sees the idiot pass in a mass of idiots " * 20,)], "text string")
    costs = toxicity.language_model(docs).tolist()
    for token, word in [("a$$", "ass"), ("idi0+", "idiot"), ("!diot", "idiot"), ("idio*", "idiot"), ("455", "ass"), ("1d1075", "idiots"), ("id" + "i" * 50 + "ot", "idiot"), ("i**ot", "idiot"), ("(idiot)", "idiot"), ("x-" * 40 + "1diot", "idiot")]:
        assert any(word in w for w in toxicity.restore(token, costs)), (token, toxicity.restore(token, costs))
    assert "idiot" in toxicity.runs("1 d 1 0 t", costs)
    assert any("idiot" in w for w in toxicity.runs(" ".join("m" * 62 + "idiot" + "m" * 30), costs))
    assert toxicity.restore("*" * 5000, costs) == []
    long = "-".join(["id1ot"] * 9)  # 53 characters
    assert sum(w == "idiot" for w in re.split("[^a-z]", " ".join(toxicity.restore(long, costs)).replace("idiot", " idiot "))) >= 9
    assert toxicity.restore("1d10t" * 9, costs)[0] == "idiot" * 9


def test_toxicity_decoding_equals_brute_force():
    rng = np.random.default_rng(5)
    costs = rng.uniform(1, 9, (28, 28, 28)).tolist()

    def cost(readings):
        x = y = 0
        total = 0.0
        for letters, price in readings:
            total += price
            for ch in letters:
                z = toxicity._class(ch)
                total += costs[x][y][z]
                x, y = y, z
        return total + costs[x][y][0]

    for token in ("1d10t", "a$$", "b00k", "s-h-1-t", "!!on", "@@ll"):
        for spaced in (False, True):
            ways = [()]
            for stretch in toxicity.lattice(token, spaced):
                ways = [w + (r,) for w in ways for r in stretch]
            best = min(ways, key=cost)
            got = toxicity.decode(token, costs, spaced)
            assert cost(best) <= min(cost(w) for w in ways if "".join(r[0] for r in w) == got) + 1e-9


def test_personal_data_discovers_by_context(spark):
    def bootstrap(rows):
        import regex

        token = regex.compile(personal_data.TOKEN)
        edges, where = set(), []
        for i, text in rows:
            base = [x.split(":") for x in plain_spans(text).split(",") if x]
            found = [(int(a), int(b), k) for k, a, b in base]
            for m in token.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b, _ in found[: len(base)]):
                    kind = "plain" if len(m[0]) < 6 else "secret" if regex.fullmatch(personal_data.SECRET.strip("^$"), m[0]) else None
                    found.append((m.start(), m.end(), kind))
                    where.append((i, m.start(), m.end(), m[0], kind))
            for a, b, kind in found:
                for p in personal_data.BEFORE:
                    if hit := regex.search(p, text[max(0, a - 48) : a].lower()):
                        edges.add((text[a:b], kind, hit[1]))
        known = {}
        while True:
            score = {}
            for instance, kind, pattern in edges:
                k, sure = (kind, 1.0) if kind else known.get(instance, (None, 0))
                if k:
                    score.setdefault(pattern, {}).setdefault(k, []).append(sure)
            sure = {}
            for pattern, by in score.items():
                best = max((k for k in by if k != "plain"), key=lambda k: (sum(by[k]), k), default=None)
                if best and sum(by[best]) >= 5 - 1e-9:
                    p = sum(by[best]) / (sum(map(sum, by.values())) + 1)
                    if p >= 0.5:
                        sure[pattern] = best, p
            fresh = {}
            for instance, kind, pattern in edges:
                if kind is None and instance not in known and pattern in sure:
                    k, p = sure[pattern]
                    fresh.setdefault(instance, {}).setdefault(k, []).append(1 - min(p, 1 - 1e-6))
            new = {}
            for instance, by in fresh.items():
                conf, k = max((1 - float(np.prod(v)), k) for k, v in by.items())
                if conf >= 0.8:
                    new[instance] = k, conf
            if not new:
                break
            known |= new
        out = {i: [(int(a), "email ip card phone".split().index(k), int(b), k) for k, a, b in (x.split(":") for x in plain_spans(t).split(",") if x)] for i, t in rows}
        for i, a, b, m, kind in where:
            k = known[m][0] if m in known else kind if kind == "secret" else None
            if k:
                out[i].append((a, "email ip card phone secret".split().index(k), b, k))
        return {i: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(v)) for i, v in out.items()}

    rows = [(i, f"some words here mailbox: user{i}@site.example.com and more") for i in range(40)]
    rows += [(100 + i, f"other words go mailbox: AB-{12345 + i} and so on") for i in range(60)]
    rows += [(300 + i, f"as asked mailbox: AB-{12345 + i} or account holder AB-{12345 + i} yes") for i in range(20)]
    rows += [(400 + i, f"only account holder ZX-{99000 + i} knows, called at {5550000 + i} 44 12") for i in range(30)]
    rows += [(500 + i, f"version {i}.0. and page {2000000 + i} of it") for i in range(30)]
    rows += [(600, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" set'), (601, None), (602, "")]
    got = personal_data.report(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").sort_index()
    assert got.spans.to_dict() == bootstrap([(i, t or "") for i, t in rows])
    assert got.loc[100:159].n_found.sum() == 60 and got.loc[400:429].n_found.sum() == 30 and got.loc[500:529].n_found.sum() == 0 and got.n_found[600] == 1


def test_personal_data_counts(spark, texts):
    got = personal_data.query(spark, SF).toPandas().set_index("doc_id")
    for i, text in texts.items():
        base = plain_spans(text or "").split(",")
        assert [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")] == [got[f"n_{k}"][i] for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, base)) <= set(got.spans[i].split(","))


def test_quality_score_is_that_of_its_rules(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    assert model.weighted
    measured = quality.statistics(docs.select("doc_id", "text"))[0].drop("text").toPandas().set_index("doc_id")
    got = quality.scored(docs, model).toPandas().set_index("doc_id").score
    odds = sum((w * np.logical_and.reduce([(measured[n] > lo) & (measured[n] <= hi) for n, lo, hi in rule.bounds]) for rule, w in model.weighted), model.intercept)
    assert np.allclose(got.loc[measured.index], 1 / (1 + np.exp(-odds)))


def test_quality_lasso_is_optimal_and_paths_are_conjunctions():
    rng = np.random.default_rng(2)
    x = (rng.random((400, 12)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 3] - x[:, 5] + rng.normal(0, 0.7, 400) > 0.5).astype(float)
    intercept, w = quality.lasso(x, y, 0.02, tolerance=1e-9)
    scale = x.std(axis=0)
    gradient = ((x - x.mean(axis=0)) / scale).T @ (1 / (1 + np.exp(-(x @ w + intercept))) - y) / 400
    assert (w == 0).any() and (np.abs(gradient[w == 0]) <= 0.02 + 1e-5).all()
    assert np.allclose(gradient[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5)
    tree = "  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0"
    inf = float("inf")
    assert {r.bounds for r in quality.paths(tree, ["a", "b"])} == {(("a", -inf, 1.5),), (("a", -inf, 1.5), ("b", 2.0, inf)), (("a", -inf, 1.5), ("b", -inf, 2.0)), (("a", 1.5, inf),)}


def test_language_fusion_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    langs = ["de", "en", "fr"]
    rows = []
    for i in range(60):
        host = ["a.x.co.uk", "b.x.co.uk", "c.y.co.uk", "www.z.de", "z.de", ""][i % 6]
        rows.append((i, f"u{i}", host, {"a.x.co.uk": "x.co.uk", "b.x.co.uk": "x.co.uk", "c.y.co.uk": "y.co.uk", "": ""}.get(host, "z.de"), host.rpartition(".")[2], ["en", "de", ""][i % 3], [float(v) for v in rng.normal(0, 3, 3)]))
    evidence = spark.createDataFrame(rows, "page_id long, url string, host string, domain string, suffix string, declared string, text_ll array<double>")
    hosts = spark.createDataFrame([(r[2], r[3]) for r in rows], "h string, d string").distinct().where("h <> ''")
    assert all(r.d == r.got for r in hosts.select("d", language.registered_domain(F.col("h")).alias("got")).collect())
    p = np.array([np.exp(np.array(r[6]) - max(r[6])) / np.exp(np.array(r[6]) - max(r[6])).sum() for r in rows])
    total = p.sum(axis=0)
    base = (total + 1) / (total.sum() + 3)
    want = {}
    for i, r in enumerate(rows):
        mine = lambda k: p[[j for j, q in enumerate(rows) if q[k] == r[k]]].sum(axis=0)  # noqa: E731, B023
        left = lambda k: np.maximum(mine(k) - p[i], 0)  # noqa: E731, B023
        domain = (left(3) + 8 * base) / (max(mine(3).sum() - 1, 0) + 8)
        prior = (left(2) + 4 * domain) / (max(mine(2).sum() - 1, 0) + 4)
        given = [(left(k) + 2 * mine(k).sum() / max(total.sum(), 1)) / (total + 2) for k in (5, 4)]
        score = np.array(r[6]) + np.log(prior) + np.log(given[0]) + np.log(given[1])
        q = np.exp(score - score.max())
        want[r[0]] = langs[int(score.argmax())], q.max() / q.sum()
    for r in language.fuse(evidence, langs).collect():
        assert r.lang == want[r.page_id][0] and abs(r.confidence - want[r.page_id][1]) < 1e-9


def test_dense_simhash_shards_are_split(spark):
    rng = np.random.default_rng(1)
    base, values = int(rng.integers(0, 2**62)), set()
    while len(values) < 1500:
        v = base
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    near = {v: {v ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)} | {v ^ (1 << a) for a in range(64)} for v in values}
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for v in values:
        for w in near[v] & values:
            parent[max(top(v), top(w))] = min(top(v), top(w))
    prints = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    for tree in (4096, 60):
        roots = {r.node: r.root for r in simhash.components(simhash.links(prints, 2, tree)).collect()}
        assert len({(top(v), roots.get(simhash._signed(v), simhash._signed(v))) for v in values}) == len({top(v) for v in values}) == len({roots.get(simhash._signed(v), simhash._signed(v)) for v in values})


def test_hot_copy_shards_are_split(spark):
    rng = np.random.default_rng(8)
    keys = [int(k) for k in rng.integers(0, 2**60, 16)]
    rows = [(i, int(rng.integers(0, 2**60)), [k if rng.random() < 0.9 else int(rng.integers(0, 2**60)) for k in keys]) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node long, fp long, keys array<long>")
    members = [r.members for r in simhash.copy_shards(nodes, 50).collect()]
    assert max(map(len, members)) < 120  # parts are dealt by a hash, and share one member
    reached, todo = set(), [0]
    by_node = {}
    for m in members:
        for _, n in m:
            by_node.setdefault(n, []).append(m)
    while todo:
        n = todo.pop()
        if n not in reached:
            reached.add(n)
            todo += [x for m in by_node.get(n, []) for _, x in m]
    assert len(reached) == 300


def _mixed_copies(rng):
    """Texts that share a long passage: near copies of a few, and others that are alike, but not enough for a link."""
    passage = [f"p{i}" for i in range(200)]
    texts = []
    for base in range(12):
        own = [f"b{base}w{i}" for i in rng.integers(0, 9000, 45)]  # similarity of two bases about 0.68
        for copy in range(6):
            words = passage + own
            for at in rng.choice(245, copy, replace=False):
                words = [*words[:at], f"e{base}_{copy}_{at}", *words[at + 1 :]]
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("near, most", [(1, 4096), (1, 24), (4, 4096)])
def test_no_link_of_a_shard_is_lost(spark, near, most):
    texts = _mixed_copies(np.random.default_rng(4))
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    keys = [set(enumerate(simhash.band_keys(simhash.min_hashes(simhash.shingle_set(t))).tolist())) for t in texts]
    parent = list(range(len(texts)))

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(texts)):
        for b in range(a):
            if keys[a] & keys[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key, hashed = simhash.row_keys(F.col("doc_id"), F.col("text"))
    rows = simhash.boxed(docs, key.alias("_key"), hashed.alias("_hash"))
    marked = docs.select("doc_id", F.struct(key.alias("_key"), hashed.alias("_hash")).alias("best"), simhash._sketches("text").alias("s")).select("doc_id", "best", "s.*")
    nodes = simhash.settle(marked)
    roots = {r.node: r.root for r in simhash.copy_roots(rows, nodes, near=near, most=most).collect()}
    got = {r.doc_id: roots.get(r.node, r.node) for r in nodes.collect()}
    assert len({(top(i), got[i]) for i in got}) == len({top(i) for i in got}) == len(set(got.values())) < len(texts) - 20


def test_ranks_cover_all_pairs():
    fps = np.random.default_rng(2).integers(0, 2**63, 90).astype(np.uint64)
    fps[40:] = fps[40]  # ties
    pairs, first = [], 0
    while first < 89:
        before = 8 * max(first, 2)
        pairs += [p for one, other in simhash.ranked(fps, first, before) for p in zip(one.tolist(), other.tolist())]
        first = before
    assert len(pairs) == len(set(pairs)) == 90 * 89 and all(a != b for a, b in pairs)


@pytest.mark.parametrize("kind", ["far", "near", "equal", "two"])
def test_near_copies_are_searched_in_a_bk_tree(monkeypatch, kind):
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**63, 2 if kind == "two" else 70).astype(np.uint64)
    if kind in ("near", "equal"):
        flips = [[int(b) for b in rng.choice(64, rng.integers(0, 9 if kind == "near" else 2), replace=False)] for _ in fps]
        fps[:] = [int(fps[0]) ^ sum(1 << b for b in bits) for bits in flips]
    nodes = np.sort(rng.choice(10**6, len(fps), replace=False))
    want = set()
    for i, f in enumerate(fps.tolist()):
        for _, j in sorted(((f ^ g).bit_count(), j) for j, g in enumerate(fps.tolist()) if j != i)[:4]:
            want.add((nodes[min(i, j)], nodes[max(i, j)]))
    searched, search = [], simhash.BKTree.nearest
    monkeypatch.setattr(simhash.BKTree, "nearest", lambda tree, values, *more: searched.extend(values.tolist()) or search(tree, values, *more))
    members = [np.array([f, n], np.int64) for f, n in zip(fps.astype(np.int64), nodes)]
    (pairs,) = simhash._candidates(4)(iter([pd.DataFrame({"members": [members]})]))
    assert set(pairs.itertuples(index=False, name=None)) == want
    assert set(searched) == set(fps.tolist())  # every fingerprint of the shard went through its tree
