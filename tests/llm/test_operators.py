"""Edge cases of every text operator on one small table, and brute force where SQL has no say."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrazzo.llm import decontaminate, html_text, language, line_dedup, lm_score, near_dedup, packing, quality_model, quality_rules, token_count
from terrazzo.llm.components import components
from terrazzo.llm.perfecthash import PerfectHash
from terrazzo.llm.shared import pack_keys, unpack_keys
from tests.oracle import canonical, rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `block` int, shard string, keys string, n string, score string, `end` string, bin string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "This very line is shared by many documents of the table."


def odd_rows():
    body = " ".join(f"word{i} and" for i in range(60))
    texts = [None, "", " \n\t\n", "one", "a b c d", "é日本語 текст", "<|endoftext|>", body, body, body + " more", "x " * 30_000, "y" * 20_000, f"{LINE}\nown\n  {LINE.upper()} ", LINE, LINE, LINE + "\n", LINE, "퟿ \x00 nul"]
    out = [(i, t, None if i % 3 else "en", None, None) + (1, "s", "k", "n", "0", "e", "b") for i, t in enumerate(texts)]
    return out + [(7, body, "en", "dup", 3, *out[0][5:]), (None, "no id here at all", "en", "x", 1, *out[0][5:]), (None, None, None, None, None, *out[0][5:])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def bag(text):
    w = WORDS.findall(low(text))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(table):
    """Class ids by comparing all pairs."""
    table = [(i, bag(t)) for i, t in table if i is not None]
    parent = {i: i for i, _ in table}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = collections.defaultdict(list)
    for n, (i, a) in enumerate(table):
        near = {m for w in a for m in held[w]}  # texts without a window in common have no link
        for w in a:
            held[w].append(n)
        for j, b in (table[m] for m in near):
            both = sum((a & b).values())
            if both and both >= 0.8 * (a.total() + b.total() - both) - 1e-9:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_language(spark, docs, odd, empty):
    got = language.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()
    model = language.fit(docs)
    mixed = model.label(["the thing of and that was in the for und nicht die schlich der das ist von auch ein"])[0]
    assert [s[2] for s in mixed[2]] == ["en", "de"]
    out = language.identify(odd, model).collect()
    assert len(out) == odd.count() and {r["lang_pred"] for r in out if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert language.identify(empty, language.fit(empty)).count() == 0 and language.LanguageModel({}).label(["a"])[0][0] == "und"


def test_language_equals_brute_force(spark, docs):
    import unicodedata

    model = language.fit(docs)
    names, penalty = model.languages, language.PENALTY

    def slot(a, b, c):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 17

    def words(text):
        out, word = [], ""
        for ch in text + " ":
            kind = unicodedata.category(ch)[0]
            if kind == "L" or (kind == "M" and word):
                word += ch.lower() if len(ch.lower()) == 1 else ch
            elif word:
                out.append(word)
                word = ""
        return out

    def scores(word):
        codes = [0, 0, *map(ord, word), 0]
        slots = [slot(codes[i - 2] if codes[i - 1] else 0, codes[i - 1], codes[i]) for i in range(2, len(codes))]
        own = [model.own[k][script_of(word[0]) - 1] for k in range(len(names))]
        if not any(own):
            return [0.0] * len(names)
        return [float(sum(model.table[k][x] for x in slots)) - 50 * (not own[k]) for k in range(len(names))]

    def script_of(ch):
        for n, ranges in enumerate(language_scripts.values(), 1):
            if any(a <= ord(ch) <= b for a, b in ranges):
                return n
        return len(language_scripts) + 1

    from terrazzo.llm.codepoints import SCRIPTS as language_scripts

    def best(text):
        found = words(text or "")
        if not found:
            return "und"
        value, back = [0.0] * len(names), []
        for n, w in enumerate(found):
            top = max(range(len(names)), key=value.__getitem__)
            came = [k if not n or value[k] >= value[top] - penalty else top for k in range(len(names))]
            value = [(value[j] - penalty * (j != k)) + x for k, (j, x) in enumerate(zip(came, scores(w)))]
            back.append(came)
        state, letters = max(range(len(names)), key=value.__getitem__), [0] * len(names)
        for w, came in zip(reversed(found), reversed(back)):
            letters[state] += len(w)
            state = came[state]
        return names[max(range(len(names)), key=letters.__getitem__)]

    odd = ["\u0301\u0300 \u093e", "12 34", "e\u0301te\u0301 et les gens", "naïve straße\u0308", "日本語 the thing of", "\u0301the of and"]
    texts = [r["text"] for r in docs.collect()][:60] + odd
    assert [x[0] for x in model.label([t or "" for t in texts])] == [best(t) for t in texts]
    assert [x[0] for x in model.label(odd)][:2] == ["und", "und"]


def test_viterbi_shortcut_equals_the_full_pass():
    r = np.random.default_rng(0)
    model = language.LanguageModel({x: np.zeros(language.SLOTS + len(language.SCRIPT_NAMES), np.int64) for x in "abc"})
    for _ in range(300):
        s = r.normal(0, r.choice([0.5, 2, 6]), (r.integers(1, 40), 3))
        value = s[0].copy()
        for row in s[1:]:
            value = np.maximum(value, value.max() - language.PENALTY) + row
        path = model.path(s)
        assert np.isclose(s[np.arange(len(s)), path].sum() - language.PENALTY * (np.diff(path) != 0).sum(), value.max())


def test_bagminhash_is_unbiased():
    a, b = {1: 3, 2: 1, 3: 7, 5: 1}, {1: 1, 2: 1, 3: 12, 4: 2}
    h = near_dedup.mix(np.array([*a, *b], np.uint64))
    got = near_dedup.signatures(h, np.array([*a.values(), *b.values()]), np.array([0, 4, 8]), 8192)
    assert abs((got[0] == got[1]).mean() - 9 / 19) < 0.03


def test_near_duplicates(spark, docs, odd, empty):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.query(spark, SF).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None} == brute_classes([(r[0], r[1]) for r in odd_rows()])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    import random

    random.seed(4)
    base = [f"w{i}" for i in range(80)]
    table = []
    for i in range(120):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(80)] = f"e{random.randint(0, 30)}"
        table.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(table)


def test_near_duplicates_lose_no_link(spark):
    """Recall at sf0.01, by brute force over all pairs of texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_duplicates_of_a_bucket_that_is_salted(spark, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "SALT_ROWS", 7)
    monkeypatch.setattr(near_dedup, "GROUP", 3000)
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    random.seed(9)
    table = []
    for i in range(150):  # families that share half of their words, so that buckets hold unlike texts
        w = [f"w{j}" for j in range(40)] + [f"f{i % 6}x{j}" for j in range(30)]
        for _ in range(random.randint(0, 2)):
            w[random.randrange(70)] = f"e{random.randint(0, 40)}"
        table.append((f"k{i:03}", " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(table)


def test_short_registers_count_matches(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 256, (50, 96)).astype(np.uint8)
    b = np.where(r.random((50, 96)) < r.random((50, 1)), a, r.integers(0, 256, (50, 96))).astype(np.uint8)
    table = [(x.view(np.int64).tolist(), y.view(np.int64).tolist(), int((x == y).sum())) for x, y in zip(a, b)]
    got = spark.createDataFrame(table, "a array<bigint>, b array<bigint>, n int").select(near_dedup.matches("a", "b").alias("m"), "n").collect()
    assert all(r["m"] == r["n"] for r in got)
    assert 50 <= near_dedup.least_matches(0.8) <= 56 and near_dedup.least_matches(1.0) == 96


def test_near_duplicates_name_what_they_count(spark, empty):
    assert near_dedup.near_duplicates(empty).columns == ["doc_id", "class_id", "n_compared_links", "kept"]


def test_near_duplicates_of_ids_that_repeat_with_other_texts(spark):
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef"]
    keys = near_dedup.bags([t.encode() for t in texts])[3].view(np.int64).tolist()
    for least, other in (sorted(x, key=lambda t: keys[texts.index(t)]) for x in (texts[:2], texts[2:4], texts[4:])):
        near = other.replace("30", "x", 1)
        # 5 stands with its text of the least key; 8 and its near copy 10 with the other one, 9 with none
        table = [(5, other), (5, least), (3, least), (8, other), (10, near), (9, "alone in its class"), (1, other), (1, least), (2, least.replace("30", "x", 1))]
        for given in (table, table[:6]):
            got = near_dedup.near_duplicates(spark.createDataFrame(given, "doc_id bigint, text string")).collect()
            assert len(got) == len(given)
            assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(list({i: t for i, t in given if i not in (1, 5) or t == least}.items()))
            assert {r["doc_id"] for r in got if r["kept"]} == {8, 9, 1 if len(given) > 6 else 3}


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("most, few", [(1 << 24, 0.3), (64, 1)])  # with far too few bits nothing is lost either
def test_ids_that_a_sieve_lets_through(spark, monkeypatch, kind, most, few):
    from terrazzo.llm import shared

    monkeypatch.setattr(shared, "MOST_BITS", most)
    wanted = spark.range(0, 30_000, 10).select(F.col("id").cast(kind).alias("rep"))
    table = spark.range(-5, 30_000).select(F.col("id").cast(kind).alias("k"), "id").union(spark.createDataFrame([(None, None)], f"k {kind}, id bigint"))
    got = shared.sieved(table, "k", wanted, "rep")
    assert got.columns == ["k", "id", "__may"]
    may = {r["id"]: r["__may"] for r in got.collect()}
    assert len(may) == 30_006 and all(may[i] for i in range(0, 30_000, 10)) and sum(may.values()) <= 3000 + few * 27_006
    assert not any(r["__may"] for r in shared.sieved(table, "k", wanted.where("false"), "rep").collect())


def test_near_dedup_shuffles_few_texts_without_copies(spark, tmp_path):
    """Where tables are too large to broadcast, as they are on large inputs; two shuffles of all texts before."""
    import corpus_pipeline

    r = np.random.default_rng(6)
    texts = [" ".join(map("{:012x}".format, r.integers(0, 1 << 48, 3000).tolist())) for _ in range(300)]
    table = [(i, t, "en") for i, t in enumerate([*texts, *(t + " more" for t in texts[:2]), texts[20], None])]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/in")
    context, off = spark.sparkContext, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        context.setJobGroup("near", "near dedup")
        corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/in"), SF).write.parquet(f"{tmp_path}/out")
    finally:
        for k in off:
            spark.conf.unset(k)
        context.setLocalProperty("spark.jobGroup.id", None)
    out = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(out) == [x for x in table if x[0] < 300 or x[1] is None]
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("near")]
    store = context._jsc.sc().statusStore()
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in {s for j in jobs for s in j.stageIds} if store.lastStageAttempt(s).status().toString() == "COMPLETE")
    assert 0 < shuffled < 0.5 * sum(map(len, texts))  # 2.1 times before


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 90), (7, 7), (95, 100)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 90, 95: 90}


def test_quality_rules(spark, odd, empty):
    assert canonical(quality_rules.query(spark, SF).toPandas()) == canonical(rows(quality_rules.ORACLE, SF))
    out = quality_rules.check_quality(odd, cleaned=True).collect()
    assert len(out) == odd.count() and quality_rules.check_quality(empty).count() == 0
    for r in out:
        assert r["doc_id"] not in (0, 1, 2) or (r["n_words"], r["kept"], r["base_failed"]) == (0, False, True)


def test_html(spark):
    page = '<title>t</title><header>Site</header><nav><a href=x>Home</a></nav><article><h1>A &lt;b&gt;</h1><p>The text of&nbsp;it\n all.<p>Short.</article><div class="comments"><p>nice one</div><footer>&copy; x</footer>'
    assert html_text.extract(page) == "A <b>\n\nThe text of it all.\n\nShort."
    long = "The story of the town and its people is told in the book that was found by the river in the spring of that year. " * 3
    assert html_text.extract(f"<div>Menu</div><p>{long}</p><p>Short end.</p><p>{long}</p><p><a href=a>More links here</a></p>").split("\n\n")[1] == "Short end."
    for broken in ("", "<", "<p", "<!--", "<script>x", '<a href="', "<p>x</b></p></div>", "&am", "<div hidden>x</div>"):
        html_text.extract(broken)
    table = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, "u", page)], "page_id bigint, url string, html string")
    assert sorted(r["n_chars"] for r in html_text.extract_pages(table).collect())[:2] == [0, 0]
    assert html_text.extract_pages(table.limit(0)).count() == 0 and html_text.query(spark, SF).where("n_chars > 0").count() > 0


def test_html_names_are_signals_only():
    long = ("The story of the town and its people is told in the book that was found by the river in the spring of that year. " * 3).strip()
    parts = lambda page: html_text.extract(page).split("\n\n")
    assert parts(f'<div class="content no-sidebar"><p>{long}</p></div>') == [long]
    assert parts(f'<div class="post has-comments"><p>{long}</p><div class="comments"><p>{long} I liked it.</p></div></div>') == [long]
    assert parts(f'<article><p>{long}</p><section id="related-work"><h2>Related work</h2><p>{long}</p></section></article>') == [long, "Related work", long]
    assert parts(f'<div class="share-page-body"><article><p>{long}</p></article></div>') == [long]
    assert parts(f'<body><form action=x><nav><a href=x>Home</a></nav><div><p>{long}</p></div><button>go</button></form>') == [long]
    assert parts(f'<div class="modal"><h1>Title</h1><p>{long}</p></div><div class="cookie-notice"><p>{long}</p></div>') == ["Title", long]
    assert parts(f'<article class="comment"><p>{long} Nice.</p></article><article><p>{long}</p></article><div class="sidebar-left"><p>{long}</p></div>') == [long]
    assert [html_text.name_hint(x, False) for x in ("no-sidebar", "has-comments", "related-work", "sidebar-left", "siteFooter", "comment-body", "story", "", "ads2", "header")] == [0, 0, 1, 2, 2, 2, 0, 0, 2, 2]
    assert html_text.extract("<nav><p>" + long + "</p></nav>") == ""


def test_html_stop_words_decide(monkeypatch):
    long = ("The story of the town and its people is told in the book that was found by the river in the spring of that year. " * 3).strip()
    words = ("Sensor battery charger adapter keyboard monitor printer scanner cable router switch speaker headset camera tripod lens filter. " * 2).strip()
    page = f"<div>Start</div><div><p>{long}</p><p>Short.</p></div><div>{words}</div><div>Pay here</div><div>{words}</div>"
    with_words = html_text.extract(page)
    assert with_words == f"{long}\n\nShort."
    monkeypatch.setattr(html_text, "STOPWORDS", frozenset())
    assert html_text.extract(page) != with_words


def test_html_second_pass_equals_brute_force():
    import random

    def brute(labels, edge, lenient, tags):
        out = []
        for i, label in enumerate(labels):
            decided = [j for j, x in enumerate(labels) if x in ("good", "bad")]
            left, right = max((j for j in decided if j < i), default=None), min((j for j in decided if j > i), default=None)
            a, b = edge if left is None else labels[left], edge if right is None else labels[right]
            if label in ("good", "bad"):
                out.append(label == "good")
            elif a and b:
                out.append(a == "good" if a == b else label == "near" or lenient or (a if i - left <= right - i else b) == "good")
            elif b and label == "short" and tags[i] in html_text.CONTAINERS and tags[i] != tags[right] and i < right - i:
                out.append(False)
            else:
                out.append((a or b) == "good")
        return out

    random.seed(3)
    for _ in range(2000):
        labels = random.choices(("good", "bad", "near", "short"), (1, 1, 2, 4), k=random.randint(0, 12))
        tags = random.choices(("div", "p", "td"), k=len(labels))
        lenient = random.random() < 0.3
        edge = "good" if lenient else None
        assert html_text.settle(labels, edge, lenient, tags) == brute(labels, edge, lenient, tags)


def test_html_pages_equal_a_tree_of_elements(spark):
    """All pages of sf0.01, whose article is marked, against the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag == "br":
                self.blocks[-1] += " "
            elif tag not in ("b", "i", "a", "em"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag not in ("b", "i", "a", "em"):
                self.blocks.append("")

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        tree = Article()
        tree.feed(r["html"] or "")
        tree.close()
        want[r["page_id"]] = "\n\n".join(x for x in (" ".join(b.split()) for b in tree.blocks) if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and all(want.values())


def test_html_long_repeated_and_clashing(spark):
    para = "<p>The story of the town and its people is told in the book that was found by the river in the spring of that year.</p>"
    table = spark.createDataFrame([(1, "u", "<article>" + para * 4000, "x", 5), (1, "u", "<article>" + para, "y", 6), (1, "u", "<article>" + para, "y", 6)], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(r["text"].count("town") for r in html_text.extract_pages(table).collect())
    assert got == [1, 1, 4000]


def test_html_edges_of_a_page_are_not_boilerplate():
    long = "The story of the town and its people is told in the book that was found by the river in the spring of that year. " * 3
    long = long.strip()
    assert html_text.extract(f"<body><h1>Title</h1><p>{long}</p><p>Short end.</p><p>By the editor</p></body>").split("\n\n") == ["Title", long, "Short end.", "By the editor"]
    assert html_text.extract(f"<div>Title</div><div>{long}</div><div>End.</div>").split("\n\n") == ["Title", long, "End."]
    assert html_text.extract(f"<h1>Title</h1><h2>Subtitle</h2><p>By A. B.</p><p>{long}</p><p>End.</p><p><a href=a>More links here</a></p><p>Legal</p>").split("\n\n") == ["Title", "Subtitle", "By A. B.", long, "End."]
    middling = long[:117].strip()
    assert html_text.extract(f"<h1>Title</h1><p>{middling}</p><p>End.</p>").split("\n\n") == ["Title", middling, "End."]
    assert html_text.extract("<p>Home</p><p>Contact</p>") == ""


def test_html_of_languages_without_stop_words():
    texts = {
        "ru": "Город стоял на берегу широкой реки, и каждую весну вода поднималась почти до самых домов, так что жители перебирались наверх. " * 2,
        "pl": "Miasto stało nad brzegiem szerokiej rzeki i każdej wiosny woda podnosiła się prawie po same progi, więc mieszkańcy przenosili się wyżej. " * 2,
        "el": "Η πόλη βρισκόταν στην όχθη του μεγάλου ποταμού και κάθε άνοιξη το νερό ανέβαινε σχεδόν μέχρι τα σπίτια των κατοίκων. " * 2,
        "zh": "这座小城坐落在宽阔的河岸边，每年春天河水都会上涨，几乎淹到居民的家门口，所以人们总是提前搬到高处去住，等到夏天再回来。" * 2,
    }
    for text in texts.values():
        text = text.strip()
        half = text[: len(text) // 2].strip()
        page = f"<h1>{half[:9]}</h1><p>{text}</p><p>{half[:12].strip()}</p><p>{half}</p><p><a href=a>{half}</a></p>"
        assert html_text.extract(page).split("\n\n") == [half[:9].strip(), text, half[:12].strip(), half]
        assert html_text.extract(f"<p>{half}</p>") == half
    english = "The story of the town and its people is told in the book that was found by the river in the spring of that year. " * 3
    words = "Sensor battery charger adapter keyboard monitor printer scanner cable router switch speaker headset camera tripod lens filter. " * 2
    assert html_text.extract(f"<p>{english}</p><p>{words}</p><p>{texts['ru']}</p>").split("\n\n") == [english.strip(), texts["ru"].strip()]


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda s: " " + re.sub(r"[\W_]+", " ", (s or "").lower()).strip() + " "
    items = {r["item_id"]: norm(r["text"]) for r in bench.collect()}
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in items.items() if t in norm(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, SF).collect()}
    assert want <= got and len(got - want) <= 2
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(docs, bench, block=1500).collect()} == got
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})
    items = spark.createDataFrame([(1, LINE), (2, LINE), (3, None), (4, "!!"), (5, "own")], "item_id bigint, text string")
    hits = collections.Counter(r["item_id"] for r in decontaminate.find_passages(odd, items).collect())
    assert hits[1] == hits[2] == 6 and hits[5] == 1 and 3 not in hits and 4 not in hits
    assert decontaminate.find_passages(empty, items).count() == 0 and decontaminate.find_passages(odd, items.limit(0)).count() == 0


def test_edited_passages_are_found():
    import random

    random.seed(2)
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly juggle boxes of glass near old stone bridges and sing"
    index = decontaminate.PassageIndex([1], [passage])
    k, _ = decontaminate.budget(len(passage))
    assert k >= 7
    for _ in range(60):
        edited = list(passage)
        for _ in range(random.randint(0, k)):
            at = random.randrange(5, len(edited) - 5)
            edited[at : at + 1] = random.choice(["", "q", edited[at] + "z"])
        assert [h[1] for h in index.search(["unrelated words before " * 9 + "".join(edited) + " and words after it " * 9])] == [0]
    assert not list(index.search(["the quick brown fox jumps over the lazy dog " * 3]))
    for pad in range(40):  # repeats without a gap, at every place in a band
        found = [h[2:] for h in index.search(["z" * pad + " " + " ".join([passage] * 3) + " tail"])]
        assert found == [(pad + 1 + i * (len(passage) + 1), pad + 1 + i * (len(passage) + 1) + len(passage), 0) for i in range(3)]


def test_passages_with_a_word_replaced_are_found():
    words = "the committee published its recommendations about sustainable transportation in rural areas after months of consultation with local residents".split()
    index = decontaminate.PassageIndex([1], [" ".join(words)])
    for i, w in enumerate(words):
        edited = " ".join([*words[:i], "q" * len(w), *words[i + 1 :]])
        assert [h[1] for h in index.search([f"other words before it {edited} and other words after it"])] == [0]
    q, (k, need) = decontaminate.Q, decontaminate.budget(len(" ".join(words)))
    assert k >= max(map(len, words)) and need > 0 and q >= 6
    edits = decontaminate.least_edits(index.grams(0), decontaminate.normal(["nothing of it"])[0], q, k)
    assert edits == k + 1


def check_packing(result, texts, capacity=4096):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
    want = sorted((p, p * capacity, len(x[p * capacity : (p + 1) * capacity]), zlib.crc32(x[p * capacity : (p + 1) * capacity].tobytes())) for x in ids for p in range(-(-len(x) // capacity)))
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in result) == want
    by = collections.defaultdict(list)
    for r in result:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(map(len, ids)) // capacity)


def test_packing(spark, docs, odd, empty):
    n, bound = check_packing(packing.query(spark, SF).collect(), [r["text"] for r in docs.collect()])
    assert n <= bound + max(1, bound // 50)
    check_packing(packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).collect(), [r[1] for r in odd_rows()])
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    bins, offsets, fill = packing.best_fit([6, 5, 4, 4, 1], 10)
    assert (bins, offsets, fill) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 9], [10, 10])


def test_packing_looks_up_pretokens_not_words():
    import random

    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(path), packing.WordEncoder(path)

    def check(encode, texts, kind=pa.string()):
        data, bounds = encode(pa.array(["one left out", *texts], kind)[1:])
        ids = np.frombuffer(data, "<u4")
        assert bounds[0] == 0 and bounds[-1] == len(ids)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]

    forms = [f"{a}{w}{b}" for w in ("étrange", "word", "àöþ") for w in (w, w.capitalize(), w.upper()) for a in ("", "(", "--") for b in ("", ",", ".", ");", "2026")]
    check(encode, [" ".join(forms), "\n".join(forms)])
    assert len(forms) == 135 and len(encode.words.new) == 3 + 5 + 3  # words in lower case, marks, digits
    check(encode, ["", "don't L'été I'LL ''s", "a<b <| x<|endoftext|>y", "3×4÷2 Ⅷ ²", "e\u0301 İ Σς ſ", "é", "\xa0日本 語", "é", "\t\x00 \r", ""])
    check(encode, [])
    check(encode, ["", ""])
    rnd, tight = random.Random(6), packing.WordEncoder(path, held=50)
    letters = [*"abcXYZ019 \n  '<|>.,-!éÉßÀÿ×÷østreml", "<|endoftext|>", "\u0301", "Σ", "İ", "\xa0", "\xad", "日", "\t", "\x00", "\x7f", "ſ", "٣"]
    for turn in range(40):
        texts = ["".join(rnd.choices(letters, k=rnd.choice([0, 1, 2, 5, 30, 200]))) for _ in range(30)]
        check(tight, texts, pa.large_string() if turn % 2 else pa.string())


def test_token_counts(spark, docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.query(spark, SF).collect()} == want
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in token_count.count_tokens(odd, path).collect())
    assert got == collections.Counter((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids), len((r[1] or "").encode())) for r in odd_rows())
    assert token_count.count_tokens(empty, path).count() == 0


def test_quality_classifier(spark, odd, empty):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "quality")
    got = quality_model.query(spark, big).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and got[got.quality == 1].score.mean() - got[got.quality == 0].score.mean() > 0.7
    constant = quality_model.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality_model.score(odd, constant).collect()} == {0.5}
    model = quality_model.fit_for(spark, spark.read.parquet(f"{big}/documents.parquet"), big)
    clash = odd.withColumn("y", F.lit(1)).withColumn("__y", F.lit(2)).withColumn("id", F.lit(3))
    assert len(quality_model.fit(clash, labels).p) == 9
    assert quality_model.fit(spark.read.parquet(f"{big}/documents.parquet"), labels, text_bytes=100_000).p["W"].shape[0] == quality_model.WIDTH
    assert quality_model.score(odd, model).count() == odd.count() and quality_model.score(empty, model).count() == 0
    assert quality_model.keep_good(odd, constant).columns == odd.columns and quality_model.keep_good(odd, constant).count() == odd.count()


def test_attention_gradients():
    r = np.random.default_rng(1)
    m = quality_model.AttentionModel(5, 4, 3)
    x, begin, y = r.normal(size=(7, 5)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = m.forward(x, begin)[-1]
        return (np.log1p(np.exp(z)) - y * z).mean()

    for k, g in m.gradients(x, begin, y).items():
        i = tuple(0 for _ in m.p[k].shape)
        before = m.p[k][i]
        m.p[k][i] = before + 1e-6
        up = loss()
        m.p[k][i] = before - 1e-6
        down = loss()
        m.p[k][i] = before
        assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_lm_scores(spark, docs, odd, empty):
    def brute(table):
        train = [WORDS.findall(low(t)) + [None] for i, t in table if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
        one = collections.Counter(w for x in train for w in x)
        n, v = one.total(), len(one)
        return n, collections.Counter((i, len(x), sum(one[w] > 0 for w in x), round(sum(np.log10((one[w] + 1) / (n + v + 1)) for w in x), 6)) for i, t in table for x in [WORDS.findall(low(t)) + [None]])

    for frame, table in ((docs, [(r["doc_id"], r["text"]) for r in docs.collect()]), (odd, [(r[0], r[1]) for r in odd_rows()])):
        n, want = brute(table)
        got = lm_score.score_texts(frame).collect()
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n} and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    held = [r for r in lm_score.score_texts(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_score.score_texts(empty).count() == 0


def test_lm_scores_equal_brute_force(spark, docs):
    """Deleted interpolation token by token; the operator rounds probabilities to quarter powers of two while it learns weights."""
    table = [(r["doc_id"], ["<s>", *WORDS.findall(low(r["text"])), None]) for r in docs.collect()]
    train = [x for i, x in table if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(w for x in train for w in x[1:])
    two = collections.Counter(p for x in train for p in zip(x, x[1:]))
    total, uniform = one.total(), 1 / (len(one) + 1)
    context = collections.Counter(w for x in train for w in x[:-1])
    bucket = lambda n: n.bit_length()
    rows_ = collections.defaultdict(list)
    for x in train:
        for a, b in zip(x, x[1:]):
            rows_[bucket(context[a])].append((uniform, (one[b] - 1) / (total - 1), (two[a, b] - 1) / (context[a] - 1) if context[a] > 1 else 0.0))

    def em(p, w):
        p = np.array(p)
        w = w * (p.sum(0) > 0)
        w = w / w.sum()
        for _ in range(60):
            joint = p * w
            share = (joint / joint.sum(1, keepdims=True)).sum(0)
            w = (share + [0.5, 0, 0]) / (share.sum() + 0.5)
        return w

    whole = em([r for rs in rows_.values() for r in rs], np.array([0.2, 0.4, 0.4]))
    weights = {b: em(rs, whole) for b, rs in rows_.items()}
    weights[0] = whole * [1, 1, 0] / whole[:2].sum()
    want = {}
    for i, x in table:
        want[i] = sum(np.log10(weights.get(bucket(context[a]), whole) @ [uniform, one[b] / total, two[a, b] / max(1, context[a])]) for a, b in zip(x, x[1:]))
    got = {r["doc_id"]: r["score"] for r in lm_score.query(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.01 * abs(want[i]) + 0.01 for i in got)


def test_a_context_count_that_is_a_power_of_two(spark):
    """The commonest word, 1024 times, shares its bucket with no other; its followers are not scored by the uniform estimate."""
    table = [(i, "a b c") for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:1024]
    unseen = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm_score.score_texts(spark.createDataFrame([*table, (unseen, "a b c"), (unseen, "z y")], "doc_id bigint, text string")).where("held_out").collect()
    assert max(r["score"] for r in got) > -0.1 and all(np.isfinite(r["score"]) for r in got)
    w = lm_score.weights_by_em(np.zeros(0, np.int64), np.zeros(0, np.int64), 0.1)
    assert np.allclose(w.sum(1), 1) and np.isfinite(w).all()


def test_mixture_weights_are_a_distribution_and_raise_likelihood():
    cells = np.array([(b * (lm_score._GRID + 1) + s) * (lm_score._GRID + 1) + t for b in (0, 3) for s in (20, 40) for t in (4, lm_score._GRID)])
    w = lm_score.weights_by_em(cells, np.array([5, 1, 2, 9, 8, 3, 1, 1]), 1e-4)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[3, 2] > 0.1


def test_line_dedup(spark, odd, empty):
    assert canonical(line_dedup.query(spark, SF).toPandas()) == canonical(rows(line_dedup.ORACLE, SF))
    out = line_dedup.dedup_lines(odd)
    assert set(out.columns) == {*odd.columns, "n_lines", "n_dropped"} and out.count() == odd.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[12]["text"] == "own" and by[12]["n_dropped"] == 2 and by[16]["text"] == LINE and by[13]["text"] == "" and by[15]["text"] == ""
    assert (by[0]["text"], by[0]["n_lines"]) == ("", 1) and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_text_ids_in_one_shard_or_many(spark):
    lines = [f"this is line number {i} of a text that has enough characters" for i in range(40)]
    table = [(f"id{d:02}", "\n".join(lines[d % 7 : d % 7 + 20] + ["own line of the document, long enough to count, " + str(d), "short"]), d) for d in range(30)]
    table += [(None, "\n".join(lines[:3]), -1), (None, "\n".join(lines[:3]), -1), ("id05", "\n".join(lines[:9]), -2), ("id90", None, 0)]
    docs = spark.createDataFrame(table, "doc_id string, text string, `__block` int")

    def brute():
        held = collections.defaultdict(set)
        for i, t, _ in table:
            for x in (t or "").split("\n"):
                if i is not None and len(x) >= 40:
                    held[x.lower()].add(i)
        out = []
        for i, t, b in table:
            kept = [x for x in (t or "").split("\n") if len(held[x.lower()]) < 5 or max(held[x.lower()]) == i]
            out.append((i, "\n".join(kept), b, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
        return collections.Counter(out)

    want = brute()
    for shard, arrays in ((10**6, 1 << 26), (3, 1 << 26), (3, 0), (10**6, 0)):
        got = line_dedup.dedup_lines(docs, shard=shard, arrays=arrays)
        assert got.columns == ["doc_id", "text", "__block", "n_lines", "n_dropped"]
        assert collections.Counter(map(tuple, got.collect())) == want


def test_line_shards_tell_lines_of_one_hash_apart():
    import pyarrow as pa

    keys, prints = np.array([5, 5, 9, 1 << 63], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    shard = line_dedup.LineShard(keys, prints, np.array([5, 70_000, 6, 7]), pa.array([10, 20, 30, 40]))
    count, top = shard.probe(np.array([5, 5, 5, 9, 9, 1 << 63, 77], np.uint64), np.array([1, 2, 3, 3, 4, 4, 1], np.uint64))
    assert count.tolist() == [5, 70_000, 0, 6, 0, 7, 0] and top.to_pylist() == [10, 20, None, 30, None, 40, None]


def test_packed_keys_round_trip():
    for n in (0, 1, 2, 5000):
        keys = np.unique(near_dedup.mix(np.arange(n, dtype=np.uint64)))
        assert (unpack_keys(pack_keys(keys)) == keys).all()
    edge = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert (unpack_keys(pack_keys(edge)) == edge).all()


def test_perfect_hash():
    keys = np.unique(near_dedup.mix(np.arange(20_000, dtype=np.uint64)))
    h = PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash(keys[:0])(keys[:3]).tolist() == [-1, -1, -1]


def test_pipeline(spark, docs):
    import corpus_pipeline

    table, want = docs, [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == docs.columns
    got = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"]: r["text"] for r in table.collect()}
    assert {r["doc_id"] for r in got} == set(kept) and 0 < len(kept) < len(want)
    classes = brute_classes(list(kept.items()))
    assert all(i == c for i, c in classes.items())  # no near duplicates are left
    check_packing(got, list(kept.values()))


def test_pipeline_on_odd_tables(spark, tmp_path, odd):
    """Nulls, empty, long and repeated texts, repeated ids, columns of other names, and tables without rows."""
    import os

    import corpus_pipeline

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels.where("quality = 1"), "doc_id", "left_semi")
    extra = [c for c in odd.columns if c not in good.columns]
    table = good.select("*", *(F.lit(None).cast("string").alias(c) for c in extra)).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    passages = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    for name, frame, bench in (("odd", table, passages), ("none", odd.limit(0), passages), ("no passages", odd, passages.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, folder)
            assert kept.columns == frame.columns and kept.count() <= before.count()
        left = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert {r["doc_id"] for r in got} == {i for i, _ in left}
        check_packing(got, [t for _, t in left])
        assert name != "none" or not got
        classes = brute_classes([(i, t) for i, t in left if i is not None])
        assert all(i == c for i, c in classes.items())
    folder = spark.conf.get("spark.checkpoint.dir")
    assert sum(x.startswith("pipeline-") for x in os.listdir(folder.removeprefix("file:"))) <= 6


def test_stored_tables_go(spark):
    import os

    from terrazzo.llm.shared import remove, scratch, shared_folder, stored

    with scratch(spark) as keep:
        a, b = stored(spark.range(3), "go"), stored(spark.range(4), "stay")
        keep(b)
    folder = shared_folder(spark).removeprefix("file:")
    names = os.listdir(folder)
    assert not any(n.startswith("go-") for n in names) and any(n.startswith("stay-") for n in names) and b.count() == 4
    remove(b, a)
    assert not any(n.startswith("stay-") for n in os.listdir(folder))
