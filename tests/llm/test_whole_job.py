"""Cases in which an operator once did less than its whole job."""

import random
import zlib

import numpy as np

from mizan.llm import decontam, langid, packing, pii, secrets, wrappers
from mizan.llm.queries import tokenizer_path


def test_wrapper_slots_that_start_alike(spark):
    lead = "<p>" + "Licensed text, all rights stay with the agency and its authors, 2024. " * 2
    rows = [(i, f"http://d.example/{i}", f"<body><div><h2>Head {i}</h2></div><div>{lead}Story {i} {'tells more ' * 20}</p></div></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in wrappers.op7(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"Story {i} tells more" in got[i] for i in range(3))


def test_each_template_of_a_host_is_read(spark):
    story = "Many words of this story. " * 40
    rows = [(i, f"http://e.example/{i}", f"<body><article><p>{i} {story}</article></body>") for i in range(5)]
    rows += [(i, f"http://e.example/{i}", f"<body><div><section><p>Other page {i}.</section></div></body>") for i in range(5, 8)]
    rows += [(i, f"http://f.example/{i}", f"<body><div><div><p>{i} {story}</div></div></body>") for i in range(10, 15)]
    rows += [(i, f"http://f.example/{i}", f"<body><table><tr><td>Short note {i}.</table></body>") for i in range(15, 18)]
    rows += [(i, f"http://f.example/{i}", f"<body><div><div><ul><li>Listed {i}.</ul></div></div></body>") for i in range(20, 22)]
    got = {r["page_id"]: r["text"] for r in wrappers.op7(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Other page {i}." for i in range(5, 8)) and all(got[i] == f"Short note {i}." for i in range(15, 18))
    assert all(got[i] == f"Listed {i}." for i in (20, 21))
    assert all(got[i] == f"{i} {story}".strip() for i in (*range(5), *range(10, 15)))


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.op7(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def story(i, n=4):
    return "".join(f"<p>Story {i} tells of {k} things that nobody knew before {i * 7 + k}.</p>" for k in range(n + i % 3))


def story_text(i, n=4):
    return "\n".join(f"Story {i} tells of {k} things that nobody knew before {i * 7 + k}." for k in range(n + i % 3))


def test_the_wrapper_decides(spark):
    """No article or main element, and no class name that is on a list: what pages share and repeat tells the text."""
    menu = "<div><b>Home</b> <b>News</b> <b>Sport and all that is on every page of this site</b></div>"
    replies = lambda i: "".join(f"<div class='entry'><div>Ann {k} of {i}</div><div>I liked this story number {i} very much, {k} times.</div></div>" for k in range(i % 4 * 3))
    box = lambda i: f"<div class='partner'><a href='/buy'>Buy {i} of these</a> now</div>"
    bodies = {
        "menu.example": lambda i: f"<body>{menu}<div>{story(i)}</div></body>",  # one path for menu and text
        "layout.example": lambda i: f"<body><div class='layout no-sidebar'><article>{story(i)}</article></div></body>",
        "price.example": lambda i: f"<body><div class='share-price'>{story(i)}</div><div class='shop'>Shop {i}</div></body>",
        "replies.example": lambda i: f"<body><div class='post'>{story(i)}{box(i)}{replies(i)}</div></body>",
        "steps.example": lambda i: f"<body><div class='post'><ol>{''.join(f'<li><p>Step {k}.{i}</p>{story(i, 0)}</li>' for k in range(3 + i % 3))}</ol></div></body>",
        "beside.example": lambda i: f"<body><div><div class='post'>{story(i)}</div><div class='thread'>{replies(i)}</div></div></body>",
    }
    rows = [(100 * h + i, f"http://{host}/{i}", body(i)) for h, (host, body) in enumerate(bodies.items()) for i in range(12)]
    got = extracted(spark, rows)
    steps = list(bodies).index("steps.example")
    want = {k: "\n".join(x for j in range(3 + k % 100 % 3) for x in (f"Step {j}.{k % 100}", story_text(k % 100, 0)) if x) if k // 100 == steps else story_text(k % 100) for k in got}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_results_hang_on_the_alignment(spark):
    """Of pages by themselves nothing is constant or repeated, so their texts would differ."""
    menu = f"<div>{'Sport and all that is on every page of this site. ' * 9}</div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{menu}<div>{story(i)}</div></body>") for i in range(12)]
    alone = [(i, f"http://{i}.example/", page) for i, _, page in rows]
    assert extracted(spark, rows) == {i: story_text(i) for i in range(12)}
    assert extracted(spark, alone) != extracted(spark, rows)


def test_deep_pages_and_a_host_of_most_pages(spark):
    deep = "<div>" * 5000 + "Deep text" + "</div>" * 5000
    stairs = "".join(f"<div>step {i} " for i in range(3000))
    rows = [(0, "http://deep.example/1", deep), (1, "http://deep.example/2", stairs), (2, "http://deep.example/3", "<p>" + "</div>" * 3000 + "end")]
    rows += [(i, f"http://big.example/{i}", f"<body><div class=top>Menu of the site</div><div>{story(i)}</div></body>") for i in range(10, 400)]
    got = extracted(spark, rows)
    assert got[0] == "Deep text" and got[2] == "end" and len(got[1].split()) == 6000
    assert all(got[i] == story_text(i) for i in range(10, 400))


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "a", "don't", "é", "12", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(200))]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", tokenizer_path()).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(None, f"text number {i} of many", "aa") for i in range(1500)] + [(7, "the same again", "bb")] * 1500 + [(i, f"bb {i}", "bb") for i in range(300)]
    collected, kind = [], type(spark.range(0))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: collected.append(out := collect(self)) or out)
    models = langid.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert set(models) == {"aa", "bb"}
    assert all(sum(r["lang"] == k for r in collected[-1]) == langid.SAMPLE_DOCS for k in models)


def test_secrets_of_letters_and_around_base_spans(spark):
    rnd = random.Random(41)
    words = ["".join(rnd.choice(("re", "con", "tion", "al", "ment", "er", "in", "get", "set", "user", "name")) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    docs = [" ".join(rnd.choice(words) for _ in range(200)) for _ in range(40)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rnd.choice(alphabet) for _ in range(32)) for alphabet in (upper + lower, lower) for _ in range(20)]
    hexed = "QzX7" + "0123456789abcdef01234567" + "KvW9pQ"
    plain = ["_".join(rnd.choice(words) for _ in range(5)) for _ in range(20)] + [c * 24 for c in "-=_9A/"]
    texts = [*docs, *(f"see {k} there" for k in (*keys, hexed, *plain))]
    got = {r["doc_id"]: r["spans"] for r in secrets.op5(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    said = [got[len(docs) + i] for i in range(len(texts) - len(docs))]
    assert sum(s == "markov:4:36" for s in said[: len(keys)]) >= 0.95 * len(keys)
    assert said[len(keys)] == "markov:4:38,hex:7:32"
    assert not any("markov" in s for s in said[len(keys) + 1 :]), said[len(keys) + 1 :]


def test_account_numbers_before_capital_words(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00 2024", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 01 BIC"]
    got = {r["doc_id"]: [(x["s"], x["e"]) for x in r["iban"]] for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [(5, 32)], 1: [(0, 27)], 2: [(0, 27)], 3: []}


def test_an_article_stays_whole(spark):
    """A paragraph that all stories share, one that is mostly a link, and the answers of an interview belong to the article."""
    lead = "<p>This is the lead that the editors put before each of the stories of this series.</p>"
    link = lambda i: f"<p>See <a href='/r{i}'>the whole report number {i} of the commission on its own page</a></p>"
    answers = lambda i: "".join(f"<div class='qa'><p>Anna</p><p>Answer {k} of {i}, which is long enough to be read as a paragraph.</p></div>" for k in range(3 + i % 3))
    said = lambda i: "\n".join(f"Anna\nAnswer {k} of {i}, which is long enough to be read as a paragraph." for k in range(3 + i % 3))
    menu = "<nav><a href='/'>Home</a></nav><div><a href='/a'>News of the day</a> <a href='/b'>Sport</a></div>"
    foot = "<div><p>All that is on this site may be read by all.</p></div>"
    head, linked = "This is the lead that the editors put before each of the stories of this series.", lambda i: f"See the whole report number {i} of the commission on its own page"
    bodies = {
        "lead.example": (lambda i: f"<body>{menu}<div>{lead}{story(i)}</div>{foot}</body>", lambda i: f"{head}\n{story_text(i)}"),
        "link.example": (lambda i: f"<body>{menu}<div>{story(i, 2)}{link(i)}{story(i + 50, 2)}</div>{foot}</body>", lambda i: f"{story_text(i, 2)}\n{linked(i)}\n{story_text(i + 50, 2)}"),
        "talk.example": (lambda i: f"<body>{menu}<article>{story(i, 1)}{answers(i)}</article>{foot}</body>", lambda i: f"{story_text(i, 1)}\n{said(i)}"),
        "alone.example": (lambda i: f"<body>{menu}<article><h1>Title {i}</h1>{answers(i)}</article>{foot}</body>", lambda i: f"Title {i}\n{said(i)}"),
    }
    rows = [(100 * h + i, f"http://{host}/{i}", body(i)) for h, (host, (body, _)) in enumerate(bodies.items()) for i in range(6)]
    got = extracted(spark, rows)
    want = [text for _, text in bodies.values()]
    wrong = {k: (got[k], want[k // 100](k % 100)) for k in got if got[k] != want[k // 100](k % 100)}
    assert not wrong, list(wrong.items())[:2]


def test_menus_and_notices_beside_an_article_stay_out(spark):
    """What repeats beside the region, links beside links, and headings without text after them are no part of it."""
    links = "".join(f"<p><a href='/{k}'>More of this kind, part {k}</a></p>" for k in range(4))
    bodies = {
        "more.example": lambda i: f"<body><div>{story(i)}<div>{links}</div></div><div><p>Terms and conditions of this site.</p></div></body>",
        "head.example": lambda i: f"<body><div><h3>Our stories</h3>{story(i)}<h3>Read on</h3></div></body>",
        "side.example": lambda i: f"<body><div class='notice'><p>We use cookies on this site.</p></div><div>{story(i)}</div></body>",
    }
    rows = [(100 * h + i, f"http://{host}/{i}", body(i)) for h, (host, body) in enumerate(bodies.items()) for i in range(6)]
    got = extracted(spark, rows)
    wrong = {k: got[k] for k in got if got[k] != story_text(k % 100)}
    assert not wrong, list(wrong.items())[:2]


def test_a_document_of_one_word_over_and_over(spark, monkeypatch):
    """Alignments are worked on in parts of one list, and phrases that lie over each other are one."""
    monkeypatch.setattr(decontam, "CHUNK", 1000)
    docs = spark.createDataFrame([(1, "word " * 30_000), (2, "word " * 12), (3, "other " + "word " * 20 + "end"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "word " * 13), ("b", "word word"), ("c", "end")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (30_000, 30_000, ["a", "b"]), 2: (12, 12, ["b"]), 3: (22, 21, ["a", "b", "c"]), 4: (0, 0, [])}
    _, found = decontam.find(docs, items)
    assert found.where("doc_id = 1 and kind = 'phrase'").count() == 2


def test_joined_phrases():
    """Joined where every window of both lies in one of them, and nowhere else."""
    rnd = random.Random(6)
    for _ in range(60):
        sizes, window = np.array([20, 4]), 5
        rows = [(item, rnd.randint(0, 1), a, a + min(sizes[item], window) - 1 + rnd.randint(0, 4)) for item in (0, 1) for a in rnd.sample(range(60), 12)]
        got = decontam._joined(np.array(rows), sizes, window)
        for item in (0, 1):
            w = min(sizes[item], window)
            windows = lambda rs: {k for i, kind, a, b in rs if (i, kind) == (item, 1) for k in range(a, b - w + 2)}  # noqa: E731, B023
            assert windows(rows) == windows(got.tolist())
        assert {tuple(r) for r in got.tolist() if r[1] == 0} == {r for r in rows if r[1] == 0}
