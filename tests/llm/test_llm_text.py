"""Site style tree, winnowing, chat windows, token store, packing and the two models."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, html_text, packing, severity, subword, token_store, tokens, winnowing
from tessera.session import shared_path

SMALL = "/root/testdata/sf0.001"


def shuffled(spark, rows, schema, n=3):
    return spark.createDataFrame(rows, schema).repartition(n)


# ---------------------------------------------------------------- pages

def page(i, body, host="a.example"):
    return (i, f"https://{host}/p/{i}", body, "x")


PAGES = "page_id long, url string, html string, host string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.main_text(shuffled(spark, rows, PAGES)).collect()}


def test_pages_article_and_broken_markup(spark):
    html = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body class='has-sidebar'>"
            "<nav><ul><li>Menu</ul></nav><header><h1>Site</h1></header><div class=ad>buy</div><div id='cookie-notice'>ok?</div>"
            "<article><header><h1>Title &amp; more</h1></header><p><b>One\n two<br><p>Three &lt;p&gt; &eacute;<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"
            "<form><input>name</form><aside>side</aside><section class='comments'><article><p>first!</article></section>tail</article>"
            "<div class='sidebar'>links</div><footer>&copy;</footer>")
    rows = [page(1, html), page(2, None), page(3, ""), (4, None, "just <b>text</b>\n here", "x"), page(5, "<p>unclosed <a href='x"), page(6, html), page(6, html),
            page(7, "<div>" * 3000 + "deep" + "</div>" * 3000), page(8, "<p>a<!-- <p>no --><p hidden>b<p>c &bogus; &#x41;"), page(9, "<p>" + "long " * 50000)]
    got = texts(spark, rows)
    assert got[1] == got[6] == "Title & more\nOne two\nThree <p> é\na\nb\nc\nd\ntail"
    assert got[2] == got[3] == "" and got[4] == "just text here" and got[7] == "deep" and got[8] == "a\nc &bogus; A"
    assert got[5].startswith("unclosed") and len(got[9]) == 5 * 50000 - 1
    out = html_text.main_text(shuffled(spark, rows, PAGES)).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_pages_counted_template_branches_go(spark):
    """Unnamed template branches are removed by the tree alone; where the text is all a page
    has, it stays."""
    body = "<body><div class='xa'><p>Top of every page</p><p>Follow us</p></div><div class='xb'><p>{}</p><p>{}</p></div><div class='xc'>Same end</div></body>"
    rows = [page(i, body.format(f"story {i} begins", f"and story {i} ends"), "big.example") for i in range(120)]
    rows += [page(1000 + i, body.format(f"few {i}", f"end {i}"), "few.example") for i in range(3)]
    rows += [page(2000 + i, "<div class='x9'><p>identical</p></div>", "mirror.example") for i in range(80)]
    got = texts(spark, rows)
    assert got[7] == "story 7 begins\nand story 7 ends"
    assert got[1001] == "few 1\nend 1"
    assert got[2005] == "identical"
    tree = {(r["host"], r["path"]): r for r in html_text.style_tree(html_text.parsed_pages(
        spark.createDataFrame(rows, PAGES).select("page_id", "url", "html"))).collect()}
    low, high = tree["big.example", "/body/div.xa"], tree["few.example", "/body/div.xa"]
    assert low["pages"] == 120 and high["pages"] == 3


@pytest.mark.parametrize("pages", [2, 3, 12, 30])
def test_pages_counted_template_goes_on_small_hosts(spark, pages):
    body = "<body><div class='xa'><p>Top of every page</p><p>Follow us</p></div><div class='xb'><p>{}</p><p>{}</p></div><div class='xc'>Same end</div></body>"
    got = texts(spark, [page(i, body.format(f"story {i}", f"end {i}"), "few.example") for i in range(pages)])
    assert got == {i: f"story {i}\nend {i}" for i in range(pages)}


def test_pages_headings_of_an_article_stay(spark):
    """Section headings that every page of a host has are part of its articles; what no one
    sees is not."""
    body = ("<body><div class='q1'><p>Top</p></div><article><h1>Title {0}</h1><h2>Summary</h2><p>about {0}</p><h2>Details</h2><p>more on {0}</p>"
            "<p>Thanks for reading</p><div class='q2'>buy now</div></article><p style='color:red; DISPLAY : none'>ghost</p></body>")
    got = texts(spark, [page(i, body.format(f"item {i}"), "shop.example") for i in range(20)])
    assert got == {i: f"Title item {i}\nSummary\nabout item {i}\nDetails\nmore on item {i}\nThanks for reading" for i in range(20)}


def test_pages_without_any_names_are_separated_by_the_tree(spark):
    """No article, no main, no telling names: with the tree every template block goes and
    every block of the text stays; without it all templates stay."""
    body = ("<body><div class='ka'><div class='kb'>Welcome to us</div><ul><li>Home</li><li>News</li></ul></div><div class='kc'><div class='kd'><h1>{0}</h1><h2>Facts</h2>"
            "<p>{0} one</p><h2>View</h2><p>{0} two</p><p>Source: desk</p></div><div class='ke'><p>Most read</p><p>Sign up</p></div></div><div class='kf'><p>Imprint</p></div></body>")
    rows = [page(i, body.format(f"story {i}"), f"h{i % 7}.example") for i in range(70)]
    want = {i: f"story {i}\nFacts\nstory {i} one\nView\nstory {i} two\nSource: desk" for i in range(70)}  # a paragraph among the text's
    assert texts(spark, rows) == want
    blind = {r["page_id"]: r["text"] for r in html_text.main_text(shuffled(spark, rows, PAGES), trust=1e15).collect()}
    assert all("Imprint" in blind[i] and "Home" in blind[i] for i in blind)


def brute_tree(rows, trust):
    """(host, path) -> (importance, best) from the definition: entropies over the pages."""
    from collections import Counter, defaultdict
    looks, has, said = defaultdict(Counter), Counter(), defaultdict(Counter)
    for _, url, body, _ in rows:
        host = url.split("/")[2]
        blocks, styles = html_text.parse(body or "")
        for path, variants in styles.items():
            has[host, path] += 1
            looks[host, path].update(variants)
        for path, text, *_ in set(blocks):
            said[host, path][text] += 1
    entropy = lambda c, m: sum(-n / sum(c.values()) * np.log(n / sum(c.values())) for n in c.values()) / np.log(m)
    out = {}
    for host, path in sorted(has, key=lambda k: -k[1].count("/")):
        m, kids = has[host, path], [k for k in out if k[0] == host and k[1].rpartition("/")[0] == path]
        own = said[host, path]
        content = None if not own else 1.0 if m == 1 else 1 - min(1.0, np.mean([np.log(n) for n in own.values()]) / np.log(m))
        below = sum(out[k][0] * has[k] for k in kids) / sum(has[k] for k in kids) if kids else None
        if below is None and content is not None:
            imp = content
        else:
            inner = content if below is None else below if content is None else (below + content) / 2
            share = 0.9 ** len(looks[host, path])
            imp = (1 - share) * (min(1.0, entropy(looks[host, path], m)) if m > 1 else 1.0) + share * (inner or 0.0)
        sure = 1 - m / (m + trust) * (1 - max(imp, content or 0.0))
        out[host, path] = (imp, max([sure, *[out[k][1] for k in kids]]))
    return out


def test_pages_importance_equals_brute_force(spark):
    rng = random.Random(4)
    part = lambda i, k: rng.choice([f"<p>same {k}</p>", f"<p>one {i} {k}</p>", f"<div class='d{k}x'>mix<p>{rng.randrange(3)}</p></div>", f"<ul><li>{rng.randrange(2)}<li>z</ul>"])
    rows = [page(i, f"<body><div class='t'>{part(0, 9)}top</div>" + "".join(part(i, k) for k in range(rng.randrange(5))) + "</body>", f"h{i % 3}.example") for i in range(40)]
    rows += [page(90, "<p>alone<div><p>deep</div>", "one.example"), page(91, None, "none.example")]
    want = brute_tree(rows, 1)
    got = {(r["host"], r["path"]): (r["importance"], r["best"]) for r in html_text.style_tree(html_text.parsed_pages(
        spark.createDataFrame(rows, PAGES).select("page_id", "url", "html"))).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), (k, got[k], want[k])


def test_pages_names_and_articles_are_no_more_than_hints(spark):
    """A named branch that is the page stays, and a card does not stand for the page."""
    story = "<p>the whole long story of the page</p><p>and its end</p>"
    rows = [page(1, f"<body><div class='content-sidebar-wrap'><main><article>{story}</article></main></div><div class='footer'>f</div></body>", "w.example"),
            page(2, f"<body><div class='layout has-sidebar'><div class='text'>{story}</div><div class='sidebar'>links</div></div></body>", "x.example"),
            page(3, f"<body><div class='text'>{story}</div><article class='teaser'>card</article></body>", "y.example"),
            page(4, f"<body><form id='aspnetForm'><div>{story}</div></form></body>", "z.example"),
            page(5, f"<body><div>{story}</div><div class='sidebar'><article>card</article></div></body>", "v.example"),
            page(6, f"<body><article>{story}<div class='share'>tweet</div></article><div>outside</div></body>", "u.example")]
    got, whole = texts(spark, rows), "the whole long story of the page\nand its end"
    assert got == {1: whole, 2: whole, 3: whole + "\ncard", 4: whole, 5: whole, 6: whole}


def test_pages_table_matches_its_articles(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(rows).collect()}
    import html
    for r in rows.collect():
        a = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        a = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\n", a))))
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(y.split()) for y in a.split("\n")) if x)


# ---------------------------------------------------------------- winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, t in items:
            v = cut(t)
            m = min(10, len(v))
            windows = {tuple(v[s:s + m]) for s in range(len(v) - m + 1)} if v else set()
            for s in range(len(w) - m + 1):
                if tuple(w[s:s + m]) in windows:
                    hit |= set(range(s, s + m))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = ["Ab", "cd", "é日", "x1", "foo", "bar", "Baz", "q"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 25, 40]) + 3 * (k % 2))) for k in range(24)] + [(90, None), (91, ""), (92, "..."), (3, say(12)), (None, say(14)), (7, "zeta")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + k, say(5) + "-" + t + "! " + say(4)) for k, (_, t) in enumerate(items) if t] + [(300, None), (301, ""), (302, "!!"), (5, say(20)), (None, items[8][1])]
    docs += [(400, say(40000))]
    d = shuffled(spark, [(*x, "s", 1) for x in docs], "doc_id long, text string, hash string, uid int")
    b = shuffled(spark, [(*x, "s") for x in items], "item_id long, text string, hits string")
    got = winnowing.contamination(d, b)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_contamination(docs, items), key=str)
    kept = winnowing.drop_contaminated(d, b)
    want = {r[0] for r in brute_contamination(docs, items) if not r[5]}
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == want
    none = spark.createDataFrame([], b.schema)
    assert winnowing.contamination(d, none).where("contaminated").count() == 0
    assert winnowing.contamination(spark.createDataFrame([], d.schema), b).count() == 0


def test_winnowing_keeps_a_gram_of_every_shared_span():
    import pyarrow as pa
    from tessera.llm.frames import raw_text
    rng = random.Random(9)
    for _ in range(100):
        span = [rng.choice("abcdefgh") * 2 for _ in range(10)]
        kept = []
        for _ in range(2):
            w = winnowing.Words(*raw_text(pa.array([" ".join(rng.choice("stuv") for _ in range(rng.randint(0, 9))) + " " + " ".join(span) + " z z z"])))
            kept.append(set(w.kept(5, 10)[0].tolist()))
        assert kept[0] & kept[1]


# ---------------------------------------------------------------- chat

CONV = "conv_id long, turn long, role string, text string, span int"


def conversations():
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["yes", "no", "&amp;", "<s>", "</s>", "[INST]", "[/INST]", "&lt;", "é"]) for _ in range(n))
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "system", "be &lt; nice"), (2, 1, "user", None), (2, 2, "assistant", "")]
    rows += [(3, 0, "system", say(40))] + [(3, i, "user" if i % 2 else "assistant", say(rng.randint(0, 300))) for i in range(1, 150)]
    rows += [(4, i, "assistant", "x" * 20000) for i in range(3)] + [(5, 0, None, "no role"), (5, None, "user", "no turn"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    rows += [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (6, 3, "[/INST]", "odd role"), (7, 0, "user", "u"), (7, 1, "system", "late"), (7, 2, "assistant", "end<")]
    return rows


def expected_conversation(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[c] = (len(turns), sha(text), len(loss), sha(loss))
    return out


def test_chat_windows_keep_the_budget_beside_long_turns(spark):
    """System turns of about 305 tokens and one turn of 1,305: no window passes the budget."""
    rows = []
    for c in range(29):
        rows.append((c, 0, "system", "s" * 1200))
        rows += [(c, 1 + t, ["user", "assistant"][t % 2], "x" * (5200 if t == c % 20 else 40 * (c + t))) for t in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.chat_windows(df).select("conv_id", "n_tokens", "n_turns", "n_context").collect()
    assert max(r["n_tokens"] for r in w) <= 2048 and sum(r["n_turns"] for r in w) == len(rows)
    over = spark.createDataFrame([(1, 0, "system", "s" * 5000), (1, 1, "user", "u" * 5000), (1, 2, "assistant", "a"), (1, 3, "user", "b")], df.schema)
    got = chat.chat_windows(over).orderBy("first_pos").collect()  # a turn that fits beside no system turn
    assert [r["n_turns"] for r in got] == [1, 1, 1, 1]


def test_chat_round_trip_and_budget(spark):
    rows = conversations()
    df = shuffled(spark, [(*r, 9) for r in rows], CONV)
    windows = chat.chat_windows(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back_digest(windows).collect()}
    assert got == expected_conversation(rows)
    w = windows.collect()
    longest = {c: max(-(-(len(chat.OPEN + chat.HEAD_END + chat.CLOSE) + 3 * len(r[3] or "") + 20) // 4) for r in rows if r[0] == c) for c in {r[0] for r in rows}}
    assert all(r["n_tokens"] <= 2048 for r in w if longest[r["conv_id"]] < 1200)
    third = [r for r in w if r["conv_id"] == 3]
    assert len(third) > 3
    system = next(r[3] for r in rows if r[0] == 3)
    for r in third:  # every window starts with the system turn, and only assistant texts are under the mask
        assert r["formatted"].startswith("<s>[INST]system[/INST]" + system.replace("&", "&amp;").replace("</s>", "&lt;/s>").replace("<s>", "&lt;s>").replace("[/INST]", "&lsqb;/INST]").replace("[INST]", "&lsqb;INST]"))
        for m in r["loss_mask"]:
            assert r["formatted"][:m["start"]].endswith("[INST]assistant[/INST]") and r["formatted"][m["start"] + m["length"]:].startswith("</s>")
    assert any(r["n_context"] > 1 for r in third)  # history is repeated
    plan = windows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.read_back_digest(chat.chat_windows(spark.createDataFrame([], CONV))).count() == 0


# ---------------------------------------------------------------- tokens

def reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_word_encoder_equals_the_library():
    rng = random.Random(6)
    signs = [*" \n\t'’sS.a1é<|>-\xa0　\x1c\x85日\U0001F600", "'s", "<|endoftext|>", "  ", "\r\n", " the", "tion"]
    tried = ["", " ", "a", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(4000))]
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    enc_ids = [[*np.frombuffer(enc.encode(x), "<u4").tolist(), 0] for x in tried]
    assert enc_ids == reference_ids(tried)


def test_word_encoder_cuts_very_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "_BLOCK", 50)
    monkeypatch.setattr(tokens, "_ENTRIES", 3)
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    text = " ".join(f"word{i}  \n x" for i in range(100)) + " "
    assert [*np.frombuffer(enc.encode(text), "<u4").tolist(), 0] == reference_ids([text])[0]


def test_word_encoder_asks_the_cache_once_a_word_of_a_block():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeréñthçÉŐ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    ends = [" ", " ", "\n", ", ", ". ", "., ", "7. ", "'s, ", "? ", "日. ", "ʔ, ", " .", "!\n", "\n\n"]
    texts = ["".join(rng.choice(words) + rng.choice(ends[:13] if n % 5 else ends) for _ in range(n)).strip() for n in range(120)]
    enc, asked, whole = tokens.WordEncoder(tokens.tokenizer_path()), [], []
    cached, ids = enc._cached, enc._ids
    enc._cached = lambda keys: asked.append(keys) or cached(keys)
    enc._ids = lambda texts: whole.append(texts) or ids(texts)
    got = enc.encode_all(texts)
    assert [[*np.frombuffer(raw, "<u4").tolist(), 0] for raw in got] == reference_ids(texts)
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    assert "\t," in asked[0] and not any(k.endswith("r,") for k in asked[0]) and len(whole) < 30
    asked.clear()
    assert enc.encode_all([*texts[:9], "", "<|endoftext|> a"])[:9] == got[:9] and len(asked) == 1


def test_word_encoder_goes_on_after_a_cut(monkeypatch):
    monkeypatch.setattr(tokens, "_BLOCK", 40)
    enc, whole = tokens.WordEncoder(tokens.tokenizer_path()), []
    text, ids = " ".join(f"word{i}, and\nmore" for i in range(60)), enc._ids
    enc._ids = lambda texts: whole.append(texts) or ids(texts)
    assert [*np.frombuffer(enc.encode(text), "<u4").tolist(), 0] == reference_ids([text])[0]
    assert not whole  # no part goes to the library as a whole


def token_docs():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["the", "of", "ünder", "123", "\n", "?!"]) for _ in range(n))
    return [(i, say(rng.choice([0, 1, 5, 50, 300, 900]))) for i in range(80, 0, -1)] + [(200, None), (201, ""), (202, say(9000)), (7, say(4)), (None, "no id")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_round_trip(spark):
    rows = token_docs()
    df = shuffled(spark, [(*r, 1) for r in rows], "doc_id long, text string, shard int")
    path = shared_path(spark, "store-test")
    token_store.write_store(df, path, sample_docs=20)
    got = token_store.read_index(spark, path).collect()
    ids = dict(zip(((i, t) for i, t in rows), reference_ids([t for _, t in rows])))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((i, len(v), crc(v)) for (i, _), v in ids.items()), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):  # gapless, in doc_id order
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    some = {r["doc_id"]: r["ids"] for r in token_store.fetch(spark, path, [202, 3, 9999]).collect()}
    assert some == {i: ids[i, t] for i, t in rows if i in (202, 3)}
    blocks = spark.read.parquet(f"{path}/blocks").select("dict_hash").distinct().collect()
    assert [r["dict_hash"] for r in blocks] == [spark.read.parquet(f"{path}/dictionary").first()["dict_hash"]]


def test_token_store_empty(spark):
    path = shared_path(spark, "store-empty")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.read_index(spark, path).count() == 0


# ---------------------------------------------------------------- packing

def best_sum(counts, room):
    reach = {0}
    for n, c in counts.items():
        for _ in range(c):
            reach |= {s + n for s in reach if s + n <= room}
    return max(reach)


def test_plan_takes_the_fullest_combination():
    rng = random.Random(12)
    for _ in range(40):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(6)}
        left = dict(counts)
        for bins, picks in packing.plan_bins(counts, 40):
            for _ in range(bins):
                assert sum(n * t for n, t in picks) == best_sum(left, 40)
                for n, t in picks:
                    left[n] -= t
        assert not any(left.values())
        for fixed in (True, False):
            used = {n: 0 for n in counts}
            for bins, picks in packing.plan_bins(counts, 40, fixed):
                assert bins > 0 and sum(n * t for n, t in picks) <= 40
                for n, t in picks:
                    used[n] += bins * t
            assert used == counts


def test_packed_sequences_are_gapless_and_few(spark):
    rows = token_docs() * 3
    df = shuffled(spark, [(*r, 1) for r in rows], "doc_id long, text string, length int", 5)
    got = packing.packed(df, with_ids=True).collect()
    ids = reference_ids([t for _, t in rows])
    want = []
    for (i, _), v in zip(rows, ids):
        first = (len(v) - 1) % 2048 + 1
        cuts = [0, *range(first, len(v) + 1, 2048)]
        want += [(i, k, a, b - a, crc(v[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(len(v) for v in ids)
    assert len(by) <= -(-total // 2048) + 1
    whole = packing.sequences(packing.packed(df, with_ids=True)).collect()
    assert sum(r["n_tokens"] for r in whole) == total and all(4 * r["n_tokens"] == len(r["ids"]) for r in whole)
    assert packing.packed(spark.createDataFrame([], df.schema)).count() == 0


# ---------------------------------------------------------------- models

def test_subword_features_are_those_of_each_text():
    rng = random.Random(2)
    tried = ["", "a", " ", "word", "ab cd ab ab", "ünï cödé\n日本"] + [" ".join(rng.choice(["foo", "Bar", "b", "x  y"]) for _ in range(9)) for _ in range(5)]
    together = subword.bags(tried)
    for t, (ids, weights) in zip(tried, together):
        alone_ids, alone = subword.bags([t])[0]
        assert ids.tolist() == alone_ids.tolist() and np.allclose(weights, alone)
        assert not len(ids) or np.isclose(weights.sum(), round(weights.sum()))
    w, b = np.random.default_rng(1).normal(size=1 << subword.BUCKET_BITS), 0.3
    by_bag = [1 / (1 + np.exp(-(b + (w[i] * v).sum()))) for i, v in together]
    assert np.allclose(subword.score(tried, w, b), by_bag, atol=1e-5)


def test_subword_blocks_cover_long_texts(monkeypatch):
    monkeypatch.setattr(subword, "_BLOCK", 64)
    long = " ".join(f"w{i}" for i in range(500))
    parts = [p for i, ps in subword.blocks(["x", long, "y"]) for k, p in zip(i, ps) if k == 1]
    assert "".join(parts) == long and max(map(len, parts)) <= 128


def quality_rows():
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "evening", "quiet", "house"]) + rng.choice(["", "s", "ed"]) for _ in range(40))
    bad = [lambda: " ".join(w + "***" for w in good().split()), lambda: good().upper(), lambda: " ".join([rng.choice(good().split())] * 30)]
    rows = [(i, good() if i % 3 else bad[i // 3 % 3](), int(i % 3 > 0)) for i in range(600)]
    return rows


def test_quality_learns_and_holds_out(spark):
    rows = quality_rows()
    docs = shuffled(spark, [(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "river stone", "x"), (5002, "quiet " * 300_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (4, 5, 0), (6, 0, 0)], "doc_id long, quality int, text int")
    got = {r["doc_id"]: r for r in subword.scored(docs, labels).collect()}
    truth = {i: q for i, _, q in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and len(got) == 604
    kept = subword.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r["predicted"]}
    no_labels = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in subword.scored(docs, no_labels).collect()} == {0.5}
    assert subword.scored(spark.createDataFrame([], docs.schema), labels).count() == 0


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    n = 3000
    level = rng.integers(0, 4, n)
    row, bucket = [], []
    for i, k in enumerate(level):
        telling = rng.choice(10, size=k * 2, replace=False) if k else []
        use = np.concatenate([telling, 100 + rng.choice(200, 20, replace=False)]).astype(int)
        row += [i] * len(use)
        bucket += use.tolist()
    row, bucket = np.array(row), np.array(bucket)
    w, theta = severity.fit_ordinal(row, bucket, np.ones(len(row)), level)
    x = np.bincount(row, w[bucket], n)
    assert (np.diff(theta) >= 0).all() and (w[:10] > 0).all()
    expected = (1 - severity._sigmoid(theta[None, :] - x[:, None])).sum(axis=1)
    means = [expected[level == k].mean() for k in range(4)]
    assert means == sorted(means) and np.mean((expected > 0.5) == (level > 0)) > 0.95


def test_toxicity_flags_planted_words(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["river", "stone", "walk", "evening", "quiet", "house", "the", "of"]) for _ in range(n))
    foul = ["grubble", "snirk", "blorfing"]
    rows = []
    for i in range(900):
        t = say(60).split()
        if i % 6 == 0:
            for _ in range(1 + i // 6 % 5):
                t.insert(rng.randrange(len(t)), rng.choice(foul))
        rows.append((i, " ".join(t), int(i % 6 == 0)))
    docs = shuffled(spark, [(i, t, 1) for i, t, _ in rows] + [(5000, None, 1), (5001, "", 1), (None, "of the", 1)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in severity.severities(docs, labels).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["toxic"] == bool(x) for i, x in held]) > 0.97
    assert all(0 <= r["severity"] <= 3 for r in got.values()) and not got[5001]["toxic"] and not got[5000]["toxic"]
    many = [got[i]["severity"] for i, t, x in rows if x and sum(f in t for f in foul) >= 3]
    one = [got[i]["severity"] for i, t, x in rows if x and sum(t.count(f) for f in foul) == 1]
    assert np.mean(many) > np.mean(one)
    assert severity.severities(docs, spark.createDataFrame([], labels.schema)).where("toxic").count() == 0
    assert severity.severities(spark.createDataFrame([], docs.schema), labels).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_keep_their_contract(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SMALL).collect(), docs.schema)
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.collect()}
        assert ids <= {r["doc_id"] for r in before.collect()} and len(ids) == after.count()
        if name == "exact":
            text = {r["doc_id"]: re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in before.collect()}
            assert len(set(text.values())) == len(ids) == len({text[i] for i in ids})
        if name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            clean = {r[0] for r in brute_contamination([(r["doc_id"], r["text"]) for r in before.collect()], items) if not r[5]}
            assert ids == clean
        before = after
    packed = P.STAGES[-1][1](spark, before, SMALL)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert P.run(spark, SMALL).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_filtering_stages_decide_row_by_row(spark):
    """Rows without a doc_id or with a repeated one keep their own decisions."""
    from tessera.llm import exact_dedup, simhash
    schema = "doc_id long, text string, row_id string"
    train = [(i, t, "train") for i, t, _ in quality_rows()]
    labels = spark.createDataFrame([(i, q) for i, _, q in quality_rows()], "doc_id long, quality int")
    ids = [None, None, None, 9000, 9000, 9000, 9001, 9001]
    mixed = [(d, train[2 + k if k % 2 else 3 * k][1], f"m{k}") for k, d in enumerate(ids)]
    docs = shuffled(spark, train + mixed, schema)
    alone = [(100_000 + k, t, n) for k, (_, t, n) in enumerate(mixed)]  # the same texts under ids of their own
    scores = {r["doc_id"]: r["predicted"] for r in subword.scored(shuffled(spark, train + alone, schema), labels).collect()}
    want = {n for i, _, n in alone if scores[i]}
    assert 0 < len(want) < len(mixed)
    kept = subword.keep_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r["row_id"] for r in kept.where("row_id <> 'train'").collect()) == sorted(want)

    passage = " ".join(f"bench{k}" for k in range(12))
    far = [" ".join(random.Random(k).choices("abcdefghijklmnop", k=80)) for k in range(4)]
    rows = [(None, far[0], "n0"), (None, far[1], "n1"), (None, passage, "n2"), (5, far[2], "a"), (5, far[3] + " " + passage, "b"), (5, far[3], "c"),
            (6, far[2], "d"), (None, far[2], "n3")]
    docs = shuffled(spark, rows, schema)
    names = lambda df: sorted(r["row_id"] for r in df.collect())
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert names(winnowing.drop_contaminated(docs, bench)) == ["a", "c", "d", "n0", "n1", "n3"]
    assert names(exact_dedup.drop_exact(docs)) == ["a", "b", "c", "n0", "n1", "n2"]
    apart = shuffled(spark, [r for r in rows if r[2] != "b"], schema)
    assert names(simhash.drop_near(apart)) == ["a", "c", "n0", "n1", "n2"]
    odd = shuffled(spark, [(7, "x y", "p"), (7, "xy ", "q"), (7, "x y  ", "r")], schema)
    assert names(exact_dedup.drop_exact(odd)) == ["r"]


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_pipeline_stages_on_empty_documents(spark, stage):
    import corpus_pipeline as P
    none = spark.createDataFrame([], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    assert P.STAGES[stage][1](spark, none, SMALL).count() == 0
