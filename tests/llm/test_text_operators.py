from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from larder.llm import bpe, htmlmain, langid, licenses, secrets, tokenfiles

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_as_the_library_and_round_trip(docs, corpus, reference):
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    for i, text, *_ in corpus:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("text", ["a" * 3000, "=-" * 700, "zq" * 500 + " x", "\x1c\x1d  \x85\xa0 y", "don't I'LL", "漢字かな交じり", "aaa" + "b" * 65])
def test_bpe_hard_pieces(reference, text):
    codec = bpe.Codec.of(PATH, P.PATTERN)
    ids = codec.encode([text, ""])
    assert np.frombuffer(ids[0], "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == [text.encode(), b""]


def test_bpe_long_pieces(reference):
    """Long pieces go in stretches: as the library does, in time and memory that grow no faster than they do."""
    rng = random.Random(1)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    runs = "".join("a" * rng.randint(1, 150) + "b" for _ in range(300))
    codec = bpe.Codec.of(PATH, P.PATTERN)
    for text in (letters, runs, "ab" * 40_000, "".join(rng.choices("ab", k=20_000)), "=" * 5001 + "-" * 999, " " * 3001 + "x", "漢字" * 999, "the" * 999 + "theother" * 99):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
    eights = codec.encode(["a" * 8_000_000])
    assert len(eights[0]) // 4 == 2_000_000 == len(reference.encode_ordinary("a" * 8_000)) * 1000
    assert codec.decode(eights) == [b"a" * 8_000_000]


def test_bpe_bounds_hold_for_long_texts(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    monkeypatch.setattr(bpe, "CHUNK_PIECES", 7)
    monkeypatch.setattr(bpe, "CHUNK_TOKENS", 11)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    text = "Some words, don't they: été 漢字 12345 x " * 40
    codec = bpe.Codec.of(PATH, P.PATTERN)
    ids = codec.encode(["", text, "short", text[:99]])
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in ("", text, "short", text[:99])]
    assert codec.decode(ids) == [t.encode() for t in ("", text, "short", text[:99])]


def test_bpe_encode_and_decode_apart(docs, spark, reference):
    got = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in got} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_token_counts_across_blocks(docs, corpus, reference, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_BYTES", 64)
    got = {r["doc_id"]: r["n_tokens"] for r in tokenfiles.token_counts(docs, PATH, P.PATTERN, 50256).collect()}
    assert got == {i: len(reference.encode_ordinary(t or "")) for i, t, *_ in corpus}


def test_token_file_without_last_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_BYTES", 6)
    (tmp_path / "a.tokens").write_bytes(np.array([1, 2, 9, 9, 3, 4, 5, 6, 7], "<u2").tobytes())
    files = spark.createDataFrame([("a.tokens", 18)], "file string, bytes long")
    got = tokenfiles.scan_token_files(files, str(tmp_path), 9, 2).orderBy("place").collect()
    assert [(r["place"], r["n_tokens"]) for r in got] == [(0, 2), (1, 0), (2, 5)]


def spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_patterns(docs, corpus):
    got = {r["doc_id"]: r for r in secrets.secret_report(docs).collect()}
    for i, text, *_ in corpus:
        base = spans(text or "")
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), i
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert got[i]["spans"] == written


def test_markov_tells_random_from_ordinary(spark):
    random = ["q7Zx9LkP2vT8sWm4RbY6", "ZmFrZS1zZWNyZXQtdmFsdWUtMTIz", "xK2+pQ9/vLr8Tn3sWz7Yb5Hd", "8f3Kd92LmQz71XwPs0Vt"]
    plain = ["getUserAccountInformation", "MAX_CUSTOMER_ORDER_COUNT", "schlichtungsverfahrenskosten", "src/handlers/update/session", "internationalization", "erschlichchstscherverein", "gouvernementalisation-generale", "ththeationinganderthere"]
    df = spark.createDataFrame([(i, f"see {t} now") for i, t in enumerate(random + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(df).collect()}
    assert [bool(got[i]) for i in range(len(random + plain))] == [True] * len(random) + [False] * len(plain)
    assert got[0] == "markov:4:24"


def test_markov_on_planted_secrets_and_ordinary_text(spark):
    """Precision and recall on random strings and identifiers that no training row holds."""
    rng = random.Random(11)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "abcdefghijklmnopqrstuvwxyz0123456789"]
    parts = "river mountain window garden morning paper silver number weather station market village bridge captain doctor engine harvest island journey kitchen".split()
    planted = ["".join(rng.choices(alphabets[i % 3], k=rng.randint(24, 60))) for i in range(150)]
    styles = (lambda w: "".join(x.title() for x in w), "_".join, "-".join, "/".join, lambda w: "_".join(w).upper())
    plain = [styles[i % 5](rng.choices(parts, k=rng.randint(4, 7))) for i in range(150)]
    rows = [(i, f"first line\nsee {t} here\nlast") for i, t in enumerate(planted + plain)]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = [i for i in got if got[i]]
    assert sum(i < 150 for i in hits) >= 0.95 * 150
    assert sum(i >= 150 for i in hits) <= 0.02 * 150
    assert all(got[i] == f"markov:15:{15 + len(planted[i])}" for i in hits if i < 150)


def test_secrets_of_long_texts_end_and_repeats_and_empty_tables(spark):
    rng = random.Random(4)
    token = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60_000))
    many = "\n".join(f"{i:032x} token={i:010d}x" for i in range(3000))
    rows = [(1, token), (2, many), (2, many), (3, "é🎉\n" * 700 + "api_key: 0123456789"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.secret_report(df).collect()}
    assert got[1]["spans"] == "markov:0:60000"
    for i, text in rows[1:]:
        assert got[i]["spans"] == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans(text or ""))
    clean = [r["text"] for r in secrets.redacted(df.where("doc_id <> 1")).orderBy("doc_id").collect()]
    assert clean[:2] == ["\n".join(["<SECRET> <SECRET>"] * 3000)] * 2
    assert clean[2:] == ["é🎉\n" * 700 + "<SECRET>", None]
    assert secrets.secret_report(df.limit(0)).count() == 0


def test_redaction_keeps_columns_and_other_text(spark):
    df = spark.createDataFrame([(1, 'x token = "abcd1234efgh" y', 99, "b"), (2, None, None, None), (3, "clean", 5, "b")], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in secrets.redacted(df).collect()}
    assert got[1]["text"] == 'x <SECRET>" y'
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None
    assert got[3]["text"] == "clean"
    assert got[3]["spans"] == "b"


def test_language_held_out_and_undetermined(spark):
    random.seed(1)
    syllables = {"en": ["the", "ing", "er", "and", "tion"], "de": ["sch", "ung", "ein", "ß", "ver"], "fr": ["eau", "é", "oi", "que", "ç"]}
    rows = [(i, " ".join("".join(random.choices(syllables[lang], k=3)) for _ in range(30)), lang) for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(900, None, "en"), (901, "123 ... !!", "de"), (902, "", None), (903, rows[0][1], None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:150])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.spoken(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {900, 901, 902}


def test_foreign_latin_script_and_random_letters_go(spark):
    random.seed(2)
    plain = {
        "en": "the people of this town have been working with their neighbours for many years and they know that the river will rise when the snow melts in the mountains above them".split(),
        "de": "die leute dieser stadt arbeiten seit vielen jahren mit ihren nachbarn und sie wissen dass der fluss steigen wird wenn der schnee in den bergen schmilzt".split(),
    }
    rows = [(i, " ".join(random.choices(plain[lang], k=random.randint(8, 60))), lang) for i in range(300) for lang in [("en", "de")[i % 2]]]
    rows += [(900, "mieszkańcy tego miasta od wielu lat pracują ze swoimi sąsiadami i wiedzą że rzeka wzbierze gdy stopnieje śnieg", None), (901, "tämän kaupungin asukkaat ovat työskennelleet naapureidensa kanssa jo vuosia ja tietävät että joki nousee", None), (902, "".join(random.choices("abcdefghijklmnopqrstuvwxyz     ", k=200)), None), (903, "жители этого города работают hello с соседями много лет", None), (904, rows[0][1] + " snow", None)]
    kept = langid.spoken(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} == {*range(300), 904}


def test_language_without_labels(spark):
    got = langid.identify(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_language_is_learned_from_every_labelled_row(spark):
    # Each of the rare letters stands in one of 6,000 rows, so a part of the rows misses most of them.
    rows = [(i, chr(0x431 + i // 150) if i % 150 == 0 else "aba", "aa") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, keys, place = langid.fit(docs)
    n = langid._summed([langid.grams(t) for _, t, _ in rows])
    top = n[0][np.argsort(-n[1], kind="stable")]
    assert len(top) == len(keys) > 100 and [top[p] for p in place[:, 0]] == list(keys)
    judged = docs.withColumn("p", F.struct("lang", (F.col("doc_id") / 6000 + 0.1).alias("score")))
    assert langid.least_scores(judged)["aa"][None] == pytest.approx(langid.LOW_MARGIN * 0.11, abs=1e-3)


def test_main_text(spark):
    page = lambda body: f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav>{body}<footer>&copy; x</footer></body></html>"
    rows = [
        (1, "http://a.example/1", page("<article><h1>Head&amp;er</h1><p><b>One<br>two<p>Three   four</p><div class='comments'><p>Nice!</p></div></article>")),
        (2, "http://b.example/", None),
        (3, None, "plain text"),
        *[(10 + i, f"http://c.example/{i}", f"<body><div><p>Accept our terms</p></div><div><p>Unique body {i} text</p></div></body>") for i in range(8)],
    ]
    got = {r["page_id"]: r for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head&er\n\nOne two\n\nThree four"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == ""
    assert got[3]["text"] == "plain text"
    assert all(got[10 + i]["text"] == f"Unique body {i} text" for i in range(8))


@pytest.mark.parametrize("copies", [5, 1000])
def test_copies_of_a_page_keep_its_text(spark, copies):
    rows = [(i, f"http://d.example/{i % 7}", "<body><article class='post-17'><h1>Title</h1><p>Own words of the page</p></article></body>") for i in range(copies)]
    rows += [(2000 + i, "http://d.example/x", f"<body><article class='post-{i}'><p>Other page {i}</p></article></body>") for i in range(100, 106)]
    got = {r["page_id"]: r["text"] for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(copies)} == {"Title\n\nOwn words of the page"}
    assert all(got[2000 + i] == f"Other page {i}" for i in range(100, 106))


def test_licenses(spark):
    rows = [(1, "Some words here.\nLicensed under the Apache License, Version 2.0."), (2, "Nothing at all"), (3, None), (4, ""), (5, "the MIT building and the general public of the license office"), (6, "Intro.\n" + licenses.TEMPLATES["mit"].replace("merchantability", "x") + "\nEnd"), (7, "Released under MIT License"), (8, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0-notice", 2: None, 3: None, 4: None, 5: None, 6: "mit", 7: "mit-notice", 8: "cc-by-nc-4.0-notice"}


@pytest.mark.parametrize("name", ["mit", "apache-2.0-header", "gpl-header", "isc", "mit-notice"])
def test_license_twice_in_the_middle_of_a_text(name):
    got = licenses.best_license(f"Intro of the work. {licenses.TEMPLATES[name]} some code of the kind {licenses.TEMPLATES[name]} End of the text")
    assert (got[0], got[1]) == (name, 1.0)


def test_license_words_count_with_repeats():
    """A sixth of the words is missing, each of them one that occurs once, so that over a fifth of the distinct words is."""
    whole = licenses.words(licenses.TEMPLATES["mit"])
    once = [i for i, w in enumerate(whole) if whole.count(w) == 1]
    gone = set(once[:: 2][: len(whole) // 6])
    left = [w for i, w in enumerate(whole) if i not in gone]
    assert len(set(left)) < 0.8 * len(set(whole))
    assert licenses.best_license(f"intro {' '.join(left)} end")[0] == "mit"


def test_all_licenses_of_a_text():
    t = licenses.TEMPLATES
    text = f"Start. {t['mit']} Some code of ours. {t['bsd-3-clause']} More code. {t['apache-2.0-header']} {t['mit']} {t['lgpl-header']} {t['gpl-2.0-header']} end"
    assert [(n, c) for n, c, _, _ in licenses.all_licenses(text)] == [(n, 1.0) for n in ("mit", "bsd-3-clause", "apache-2.0-header", "mit", "lgpl-header", "gpl-2.0-header")]


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_template_names_itself_also_with_changed_words(name):
    assert licenses.best_license(f"Before it. {licenses.TEMPLATES[name]} After it.")[:2] == (name, 1.0)
    words = licenses.words(licenses.TEMPLATES[name])
    if len(words) > 60:
        rng = random.Random(name)
        plain = [i for i, tells in enumerate(licenses.telling(words)) if not tells]
        for i in rng.sample(plain, len(words) // 8):
            words[i] = f"changed{i}"
        assert licenses.best_license(" ".join(["intro", *words, "end"]))[1] > 0.8


def test_license_filter_loses_nothing(monkeypatch):
    """The same rows as by aligning every window with every template, whatever words it holds."""
    rng, t = random.Random(6), licenses.TEMPLATES
    texts = []
    for i in range(60):
        words = licenses.words(rng.choice(list(t.values())))
        kept = [w if rng.random() > (0, 0.1, 0.15, 0.2, 0.25)[i % 5] else rng.choice(["the", "of", "x", "software"]) for w in words]
        texts.append(" ".join(rng.choices(["the", "of", "code", "any", "is", "z"], k=rng.randint(0, 80)) + kept + rng.choices(["use", "or", "to", "q"], k=rng.randint(0, 80))))
    got = [licenses.all_licenses(x) for x in texts]
    assert 20 < sum(map(bool, got))
    monkeypatch.setattr(licenses, "enough", lambda here, counts, need: True)
    assert got == [licenses.all_licenses(x) for x in texts]


def test_licenses_with_own_templates_repeats_and_empty_tables(spark):
    own = {"house": "This text may be read by members of the house only", "empty": ""}
    rows = [(1, "x This text may be read by members of the house only y"), (1, "x This text may be read by members of the house only y"), (None, "a " * 300_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license string")
    got = licenses.license_scan(df, templates=own).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["coverage"], r["first_word"], r["last_word"], len(r["licenses"])) for r in got) == [(0, None, 0.0, None, None, 0), (1, "house", 1.0, 1, 11, 1), (1, "house", 1.0, 1, 11, 1)]
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_patience_alignment():
    a, b = "a b c d e f g".split(), "a x c d y g".split()
    assert licenses.aligned(a, b) == [(0, 0), (2, 2), (3, 3), (6, 5)]
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 4.0", None), ("Licensed under CC BY-NC-ND 4.0", None), ("Licensed under CC BY-NC 4.0 International", "cc-by-nc-4.0-notice"), ("Licensed under CC BY-NC 4.0-ND", None),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", None), ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", None),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0-notice"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0-notice"), ("licensed under a Creative Commons Attribution 3.0 International License", None),
        ("This work is licensed under the GNU General Public License, version 2", None), ("This work is licensed under the GNU Lesser General Public License, version 3", None), ("The project is licensed under the GNU General Public License, version 3.", "gpl-3.0-notice"),
        ("Released under the Apache License", None), ("Released under the BSD license", None), ("Released under the publisher's license agreement", None), ("They released it under the old MIT name, with no license", None), ("This old work was made this way. Released under the MIT license by this team", "mit-notice"),
        ("Licensed under the Apache License, Version 1.1", None), ("It is licensed under the Apache License, Version 2.0 or the MIT license", "apache-2.0-notice"),
    ],
)
def test_a_license_is_not_its_neighbour(text, want):
    assert licenses.best_license(f"Some words before. {text}")[0] == want


@pytest.mark.parametrize("pair", [("gpl-header", "version 3", "version 2"), ("lgpl-header", "2.1", "3.0"), ("agpl-header", " Affero", ""), ("gpl-2.0-header", "GNU General", "GNU Affero General"), ("apache-2.0-header", "Version 2.0", "Version 1.1"), ("mpl-2.0-header", "v. 2.0", "v. 1.1")])
def test_headers_of_other_versions_are_no_license_known(pair):
    name, old, new = pair
    assert licenses.best_license(licenses.TEMPLATES[name].replace(old, new))[0] != name


def test_alignments_are_common_subsequences_near_the_longest():
    rng = random.Random(2)
    for name in ("mit", "zlib", "gpl-header", "apache-2.0-header"):
        a = licenses.words(licenses.TEMPLATES[name])
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(10):
            b.insert(rng.randrange(len(b)), rng.choice(["the", "of", "new"]))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        assert 0.97 * longest[-1][-1] <= len(pairs) <= longest[-1][-1]


def brute_profiles(rows, most):
    """N-grams of one to three characters by language, most frequent first, from the operator's own n-gram counts added up."""
    from collections import Counter

    counts = {}
    for lang, text in rows:
        key, n = langid.grams(text)
        counts.setdefault(lang, Counter()).update(dict(zip(key.tolist(), n.tolist())))
    return {lang: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]] for lang, c in counts.items()}


def test_language_distances_equal_brute_force(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ba", "lo", "mi", "ré"], "bb": ["schn", "ug", "ext", "ö"], "cc": ["ko", "ni", "ta", "lo"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(rng.choices(sorted(syllables), k=90))]
    rows += [rows[3], rows[3], (500, "", "aa"), (501, None, "bb"), (502, "lo " * 40_000, "cc"), (503, "same same", None), (504, "x", "aa")]
    import zlib

    learned = [(lang, t) for i, t, lang in rows if lang and t and zlib.crc32(str(i).encode()) % 5]
    profiles = brute_profiles(learned, langid.RANKS)
    got = langid.identify(spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, score string, held_out int")).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        text = text_of[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        own = brute_profiles([("x", text)], langid.RANKS)["x"] if text else []
        if not own:
            assert r["lang_pred"] == "und"
            continue
        away = {lang: sum(abs(p.index(g) - k) if g in p else langid.RANKS for k, g in enumerate(own)) for lang, p in profiles.items()}
        assert away[r["lang_pred"]] == min(away.values()) and r["score"] == pytest.approx(1 - min(away.values()) / (len(own) * langid.RANKS), abs=1e-9)
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
