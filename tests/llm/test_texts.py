import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import encoding, leakage, packing

# ---- 8: containers


def slow_first_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        k = next((i for i, x in enumerate(left) if x >= s), len(left))
        if k == len(left):
            left.append(capacity)
        left[k] -= s
        out.append(k)
    return out


def test_first_fit_is_first_fit():
    random.seed(1)
    for _ in range(60):
        sizes = sorted((random.randrange(1, 60) for _ in range(random.randrange(0, 80))), reverse=True)
        assert packing.first_fit(sizes, 64) == slow_first_fit(sizes, 64)


def test_pack_places_every_token_once(spark):
    random.seed(2)
    texts = {i: " ".join(random.choice(["word", "другой", "語", "x1"]) for _ in range(random.choice([1, 5, 40, 200, 700]))) for i in range(120)}
    rows = [*texts.items(), (500, None), (501, ""), (502, " \n "), (0, texts[0])]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("text", F.lit("clash"))
    got = packing.pack(df, "id", "body", capacity=256, group_size=40).collect()
    encode = packing.tokenizer().encode_ordinary
    size = {i: len(encode(t)) for i, t in texts.items()} | {502: len(encode(" \n "))}
    assert {r.id for r in got} == set(size)
    for i, n in size.items():
        own = sorted((r.start_token, r.n_tokens) for r in got if r.id == i)
        assert sum(x for _, x in own) == n * (2 if i == 0 else 1)
        assert all(x == min(256, n - s) for s, x in own) and (n > 256 or all(s == 0 for s, _ in own))
    for _, pieces in itertools.groupby(sorted(got, key=lambda r: (r.container, r.place)), key=lambda r: r.container):
        pieces = list(pieces)
        assert [p.place for p in pieces] == list(range(1, len(pieces) + 1)) and sum(p.n_tokens for p in pieces) <= 256
        assert [p.offset for p in pieces] == list(itertools.accumulate([0, *(p.n_tokens for p in pieces[:-1])]))
    again = packing.pack(df.repartition(3), "id", "body", capacity=256, group_size=40)
    whole = packing.fill(again, 256).first()
    assert whole.fill_rate > 0.9 and whole.least_containers == -(-whole.tokens // 256) <= whole.containers
    assert packing.pack(df.limit(0), "id", "body").count() == 0


# ---- 9: leaks


def sentence(rng, words, n):
    return [words[i] for i in rng.integers(0, len(words), n)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(400)]
    items = {i: sentence(rng, words, int(rng.integers(20, 60))) for i in range(20)}
    docs, truth = {}, set()
    for d in range(150):
        own = sentence(rng, words, 80)
        kind, i = d % 5, int(rng.integers(20))
        if kind < 3:
            passage = list(items[i][:16] if kind == 0 else items[i])
            if kind == 1:  # every sixth word changed
                passage = [w if (k + 1) % 6 else "damaged" for k, w in enumerate(passage)]
            if kind == 2:  # a word added or left out now and then
                passage = [x for k, w in enumerate(passage) for x in ([w, "extra"] if k % 9 == 4 else [] if k % 9 == 8 else [w])]
            own[20:20] = passage
            truth.add((d, i))
        elif kind == 3:
            own[20:20] = items[i][:7]
        docs[d] = own
    return items, docs, truth


def test_leaks(spark, corpus):
    items, docs, truth = corpus
    rows = [(d, "  ".join(w.upper() if d % 2 else w + "," for w in ws)) for d, ws in docs.items()] + [(900, None), (901, ""), (None, " ".join(items[0]))]
    table = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()] + [(77, None), (78, "too short"), (0, " ".join(items[0]))], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(5))
    got = {tuple(r)[:2] for r in leakage.find_leaks(df, table, "doc_id", "text", "item_id", "text").withColumnRenamed("item_id", "i").select("doc_id", "i").collect()}
    assert got == truth
    assert leakage.find_leaks(df.limit(0), table, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.find_leaks(df, table.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_shuffled_items_give_the_same(spark, corpus, monkeypatch):
    items, docs, truth = corpus
    table = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()] + [(100 + i, " ".join(items[0][:18])) for i in range(5)], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs.items()], "doc_id long, text string")
    ask = lambda: {tuple(r) for r in leakage.find_leaks(df, table, "doc_id", "text", "item_id", "text").collect()}
    whole = ask()
    assert {r[:2] for r in whole} >= truth and {r[:2] for r in whole if r[1] < 100} == truth
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 100)
    monkeypatch.setattr(leakage, "SHARERS", 2)
    monkeypatch.setattr(leakage, "BITMAP", 1 << 16)
    assert ask() == whole
    monkeypatch.setattr(leakage, "MOST_WORDS", 390)  # in groups of items
    assert {r[:2] for r in ask()} == {r[:2] for r in whole}


def found_in(items, docs):
    lists = [leakage.words_of(t) for t in items]
    v = leakage.Vocabulary(sorted({w for ws in lists for w in ws}))
    table = leakage.Items(list(range(len(items))), [np.array([v.number[w] for w in ws], dtype=np.int64) for ws in lists])
    return {(d, n) for d, n, *_ in leakage.search(table, [v.read(t) for t in docs])}


@pytest.mark.parametrize("length", [15, 16, 18, 20, 30])
@pytest.mark.parametrize("changed", [0, 1, 2, 3, 4])
def test_recall_of_changed_passages(length, changed):
    """Passages with single words changed at places drawn at random, the ends included: recall and precision by length and changes."""
    rng = np.random.default_rng(length * 10 + changed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]
    weight = 1 / (np.arange(3000) + 2.7)  # word frequencies as in free text
    often = lambda n: [words[i] for i in rng.choice(3000, n, p=weight / weight.sum())]
    items = [often(60) for _ in range(80)]
    docs, truth = [], set()
    for d in range(240):
        own = often(150)
        if d % 3 < 2:
            n, a = d % 80, int(rng.integers(0, 60 - length + 1))
            passage = items[n][a : a + length]
            # No two neighbours: single words.
            spots = []
            while len(spots) < changed:
                k = int(rng.integers(length))
                if all(abs(k - x) > 1 for x in spots):
                    spots.append(k)
            for k in spots:
                passage[k] = "other" + str(k)
            own[70:70] = passage
            truth.add((d, n))
        docs.append(own)
    got = found_in([" ".join(x) for x in items], [" ".join(x) for x in docs])
    assert len(got & truth) >= 0.9 * len(truth), len(got & truth) / len(truth)
    assert len(got & truth) >= 0.99 * len(got), sorted(got - truth)[:5]


def test_templates_are_no_leak():
    """Sentences of one template with other fillings share most of their words, which say nothing."""
    rng = np.random.default_rng(4)
    slot = lambda c: " ".join(f"{c}{rng.integers(40)}" for _ in range(3))
    fill = lambda: f"moderators of the {slot('w')} desk propose {slot('x')} before dates rather than {slot('y')} beside prices for all users"
    items, docs = [fill() for _ in range(60)], [fill() for _ in range(60)]
    got = found_in(items, docs + items)
    assert {(60 + n, n) for n in range(60)} <= got and len(got) - 60 <= 0.001 * 60 * 120


def test_words_ignore_formatting():
    plain = leakage.words_of("The café's naïve door")
    for other in ("THE CAFÉ’S naive  door", "the\ncafe's naïve—door!", "The ca­fé's na​ïve door", "Thе cаfé's naïve door"):
        assert leakage.words_of(other) == plain


def test_damaged_letters_are_read():
    items = leakage.Vocabulary(["lighthouse", "rental", "shows", "tilted", "prompt"])
    want = items.read("lighthouse rental shows tilted prompt").tolist()
    assert items.read("lighthuse rentall shwos tiltedd pronpt").tolist() == want
    assert items.read("something else").tolist() == [-1, -1]
    for text in ("Tilted ½ prompt", "5½ shows; LIGHT­HOUSE", "the ½½ ① ﬁ"):
        assert items.read(text).tolist() == [items._number(w) for w in leakage.words_of(text)]


# ---- 10: encodings


@pytest.fixture(scope="module")
def clean():
    base = {
        "de": "Auf kleinen Geräten gilt: die Fußleiste ist für große Schrift zu schmal, daher wählen viele die Übersicht. Müde Prüfer hätten länger gewählt.",
        "fr": "À l'essai, l'en-tête reste caché derrière la légende et le côté pratique disparaît. Il faudrait préciser l'unité dès le début.",
        "es": "Convendría añadir una explicación; ¿por qué la sección vacía no indica qué ocurrirá mañana? Según la revisión, el botón también falla.",
        "en": "It’s enough — the rater wasn’t sure. The label “No. 4” costs €12 at the café; the façade photo (±3 px) isn’t sharp.",
        "pl": "Według oceny przełącznik zasłania ostatni wiersz. Można też zwiększyć odstęp albo dodać krótki opis. Należałoby ujednolicić wygląd.",
        "ru": "Лучше увеличить отступ или показать единицу измерения. Подпись не меняется после нажатия, поэтому новички ошибаются.",
        "pt": "ATENÇÃO À POSIÇÃO: a ação principal fica invisível. NÃO ESTÁ CLARO: muitos não sabem voltar. É possível manter o botão visível.",
        "ja": "色を一つに絞るとよいでしょう。見出しは端に近すぎます。単位を示すことを勧めます。",
    }
    return base


WAYS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "koi8_r")]


def spoil(text, written, read):
    data = text.encode(written, "ignore")
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_garbled_texts(spark, clean):
    rows, want = [], {}
    n = 0
    for k in range(60):
        for text in clean.values():
            rows.append((n, text if k % 2 else text.replace(". ", ".\n")))
            n += 1
    languages = {"cp1250": ["pl"], "cp1251": ["ru"], "cp1252": ["de", "fr", "es", "en"], "utf-8": ["de", "fr", "es", "en", "pt"]}
    for written, read in WAYS:
        for lang in languages[written]:
            text = clean[lang]
            rows.append((n, spoil(text, written, read)))
            want[n] = text if written == "utf-8" else None
            n += 1
    rows += [(n, spoil(spoil(clean["de"], "utf-8", "cp1252"), "utf-8", "cp1252")), (n + 1, clean["fr"].encode("latin-1").decode("utf-8", "replace")), (n + 2, "Plain. " * 200 + spoil("für größere Geräte", "utf-8", "cp1252") + " Plain." * 200)]
    want |= {n: clean["de"], n + 1: None, n + 2: "Plain. " * 200 + "für größere Geräte" + " Plain." * 200}
    n += 3
    quoting = ["The screenshot shows “GrÃ¶ÃŸe” where “Größe” belongs.", "The button literally reads “naÃ¯ve” on screen – the app’s own bug."]
    rows += [(n + i, q) for i, q in enumerate(quoting)] + [(n + 9, None), (n + 10, ""), (n + 11, "plain ascii &#39;fine&#39;")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {r.doc_id: r for r in encoding.find_garbled(df, "doc_id", "text").collect()}
    assert set(got) == set(want)
    whole = [i for i, t in want.items() if t is not None]
    right = sum(unicodedata.normalize("NFC", got[i].restored) == want[i] for i in whole)
    assert right >= 0.85 * len(whole), [(got[i].restored, want[i]) for i in whole if got[i].restored != want[i]][:3]
    assert not next(r for i, r in got.items() if "�" in (r.restored or "")).complete
    assert encoding.find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_references_to_garbled_characters(spark, clean):
    spoiled = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in spoil(clean["en"], "utf-8", "cp1252"))
    rows = [(i, t) for i, t in enumerate([*clean.values()] * 40)] + [(999, spoiled)]
    got = encoding.find_garbled(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert [(r.doc_id, r.restored) for r in got] == [(999, clean["en"])]


@pytest.mark.parametrize(("size", "share"), [(180, 0.03), (1800, 0.001), (1800, 0.03), (1800, 0.2), (12000, 0.0005), (12000, 0.2)])
def test_garbled_share_at_every_size(spark, clean, size, share):
    """UTF-8 read as something else is found in small and large corpora, whether it is rare or frequent."""
    rng = random.Random(size)
    langs = ["de", "fr", "es", "en", "pl", "pt"]
    wanted = max(1, int(size * share))
    rows, truth = [], set()
    for i in range(size):
        lang = rng.choice(langs)
        text = " ".join(rng.sample(clean[lang].split(), 12)) + f" {i}"
        if i < wanted and not text.isascii():
            text = spoil(text, "utf-8", ["cp1252", "mac_roman", "cp437"][i % 3])
            truth.add(i)
        rows.append((i, text))
    got = {r.id for r in encoding.find_garbled(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text").collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.0005 * size, (len(got & truth), len(truth), len(got - truth))


def test_quoted_labels_and_quoted_passages(spark, clean):
    bad = lambda t: spoil(t, "utf-8", "cp1252")
    labels = [f"The head reads “{bad('Größe')}” here.", f"Caption broken in the app itself ({bad('Année')}), please fix.", f"It is drawn as {bad('Übersicht')}; it should print Übersicht.", f"Label «{bad('Müde Prüfer')}» is the app's own."]
    passages = [f"They wrote “{bad('für große Schrift zu schmal, daher wählen viele')}” twice.", f"({bad('Il faudrait préciser l’unité dès le début')})", f"It is drawn as {bad('Übersicht')}. Later it should print Übersicht.", bad("“Größe” or “Länge”")]
    rows = [*enumerate([*clean.values()] * 30), *((900 + i, t) for i, t in enumerate(labels)), *((950 + i, t) for i, t in enumerate(passages))]
    got = {r.id for r in encoding.find_garbled(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {950, 951, 952, 953}


def test_mixed_up_all_over_the_corpus(spark, clean):
    """Windows text read as Mac in a tenth of all texts."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(clean[lang].split(), 14))) for i in range(1500) for lang in [rng.choice(["de", "fr", "es", "pt"])]]
    truth = {i for i, t in rows if i % 10 == 0 and sum(c > "\x7f" for c in t) >= 2}
    df = spark.createDataFrame([(i, spoil(t, "cp1252", "mac_roman") if i in truth else t) for i, t in rows], "id long, text string")
    got = {r.id for r in encoding.find_garbled(df, "id", "text").collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 2, (len(got & truth), len(truth), len(got - truth))
