"""Chats, pages, components and the pipeline against plain versions on small rows."""

import itertools
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from yieldloom.llm import bpe, common, components, jaccard, pseudonyms, quality, roles, templates, wrappers

FOLDER = "/root/testdata/sf0.001"


def best_cost(given):
    """Least cost over all sequences of states and steps."""
    table = roles.tables()
    costs = list(roles.FRESH)
    for r in given:
        costs = roles.forward(costs, r, table)
    return min(costs[s] + roles.CLOSING[s] for s in range(4))


def brute_cost(given):
    table, best = roles.tables(), [roles.FAR]
    moves = [table[r if r in roles.NAMES[1:] else None] for r in given]

    def go(k, state, cost):
        if k == len(moves):
            best[0] = min(best[0], cost + roles.CLOSING[state])
        for came, to, c, _ in moves[k] if k < len(moves) else ():
            if came == state:
                go(k + 1, to, cost + c)

    go(0, roles.START, 0)
    return best[0]


@pytest.mark.parametrize("given", [*itertools.product(["system", "user", "assistant", None], repeat=4)])
def test_role_costs(given):
    assert best_cost(given) == brute_cost(given)
    taken, _ = roles.path(roles.FRESH, list(given), None, roles.tables())
    said = [roles.NAMES[to] for _, to, _ in taken]
    chat = "".join(roles.render(taken, ["t"] * 4, True))
    heads = [line[2:-2] for line in chat.split("\n") if line.startswith("<|") and line != "<|end|>"]
    rest = heads[1:] if heads[0] == "system" else heads
    assert rest == ["user", "assistant"] * (len(rest) // 2) and rest and set(said) <= {"system", "user", "assistant"}


def test_roles_over_partitions(spark):
    """A conversation over many partitions is repaired as in one piece."""
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["system", "user", "user", "assistant", None, "bot", " User "]), f"t{k}", "x") for k in range(400)]
    rows += [(c, k, rng.choice(["user", "assistant"]), f"c{k}", "x") for c in (1, 2, 9) for k in range(5)]
    rows += [(None, None, None, None, None), (3, 1, "assistant", None, "x"), (3, 1, "assistant", None, "x"), (4, None, "user", "z" * 20_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, clean string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = roles.repair_roles(df.repartition(5)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = roles.repair_roles(df.coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(map(tuple, many)) == Counter(map(tuple, one)) and len(many) == len(rows)
    assert roles.repair_roles(df.limit(0)).collect() == []


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav>"
    "<div class='ad'>Buy</div>{}<footer>&copy; x</footer></body></html>"
)


def test_pages(spark):
    article = PAGE.replace("{}<footer", "<article><h1>Head &amp; more</h1><p>One\n  two <b>bold</b>&nbsp;x<p>Three<br>four<div class='comments'>bad</div></article>" + "<footer")
    plain = PAGE.replace("{}<footer", "<div id='body1'><p>{}</p><p>{}</p></div><div class='sidebar'>links</div>" + "<footer")
    pages = [(1, "http://a.example/x", article), (2, None, None), (3, "http://b.example/", "")]
    pages += [(10 + k, f"http://c.example/{k}", plain.replace("{}", f"long text number {k} " * 9)) for k in range(6)]
    pages += [(20, "http://d.example/", "<p>unclosed <a href='x\"y>z"), (21, "http://d.example/", "x < y & z"), (1, "http://a.example/x", article)]
    rows = [(*p, "clash") for p in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r.page_id: r for r in wrappers.extract_main_text(df).collect()}
    assert got[1].text == "Head & more\n\nOne two bold x\n\nThree four" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[21].text == "x < y & z"
    for k in range(6):
        assert got[10 + k].text == "\n\n".join([("long text number %d " % k * 9).strip()] * 2)
    assert len(got) == 11 and wrappers.extract_main_text(df).count() == 12
    assert wrappers.extract_main_text(df.limit(0)).collect() == []


def test_constant_text_of_a_host(spark):
    """Text that all pages of a host share is left out, within a marked main element too; slots stay."""
    said = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(4)]
    shared = "<p>Follow our shop for offers.</p>"
    marked = "<body><article><h1>t{0}</h1>" + shared + "<p>{1}</p><ul><li>Print</li><li>Send</li></ul></article></body>"
    plain = "<body><div id='a'><div id='b'>Since 1999</div><p>{1}</p>" + shared + "<p>{1} again</p><div id='b'>note {0}</div></div></body>"
    shell = "<body><main>Loading</main><div id='a'><p>{1}</p></div></body>"
    rows = [(10 * h + k, f"http://h{h}.example/{k}", page.format(k, said[k])) for h, page in enumerate((marked, plain, shell)) for k in range(4)]
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(4):
        assert got[k] == f"t{k}\n\n{said[k]}" and got[20 + k] == said[k]
        assert got[10 + k] == f"{said[k]}\n\n{said[k]} again\n\nnote {k}"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='no-sidebar'><p>{}</p></body>", "<body class='fixed-header'><p>{}</p></body>", "<main class='site-main has-sidebar'><p>{}</p></main>",
        "<body class='sidebar'><article class='post comments-open comments'><p>{}</p><div class='comments'>bad</div></article></body>",
        "<html><head><meta charset='utf-8'><title>T</title><body><p>{}</p></body></html>", "<head><title>T</title><p>{}</p>", "<head><title>T</title>\n{}",
        "<svg viewBox='0 0 1 1'/><p>{}</p>", "<p>{}</p><math/>", "<iframe src=http://a.example/>x</iframe><p>{}</p>", "<svg hidden/><p>{}</p><svg><text>bad</text></svg>",
        "<div class='cookie-banner'>bad</div><div id='ad-12'>bad</div><p>{}</p>", "<p>{}</p><script>bad",
    ],
)
def test_no_article_is_lost(page):
    assert wrappers.main_text(page.format("said &lt; x"), None, []) == "said < x"


def test_alignment():
    own = lambda html: wrappers.expression(wrappers.parse(html))
    a, b = own("<body><h1>x</h1><p>one</p><p>two</p><hr><div>same</div></body>"), own("<body><h1>y</h1><h2>s</h2><p>one</p><div>same</div></body>")
    body = wrappers.fused(a, b)[wrappers.PARTS][0]
    assert [(p[0], p[1], p[2], p[3]) for p in body[wrappers.PARTS]] == [("h1", False, False, "#"), ("h2", True, False, "=s"), ("p", False, True, "#"), ("div", False, False, "=same")]


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 140)]
    edges = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(5, 5)]
    root = {n: n for e in edges for n in e}
    top = lambda x: x if root[x] == x else top(root[x])
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == top(n) for n in root)
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark):
    """Every stage against its operator's decisions on the rows before it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    kept = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    rows = [r for r in rows if r.doc_id in kept]
    sets = {r.doc_id: set(jaccard.shingles(r.text).tolist()) for r in rows}
    root = {d: d for d in sets}
    top = lambda x: x if root[x] == x else top(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        if min(len(sets[a]), len(sets[b])) * 100 >= 85 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    rows = [r for r in rows if top(r.doc_id) == r.doc_id]
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaked = {r.doc_id for r in templates.decontaminate(docs, items).collect()}
    rows = [r for r in rows if r.doc_id not in leaked]
    hide, coder = pseudonyms.Pseudonyms(), bpe.codec()
    want = {r.doc_id: coder.encode(hide.replace(r.text)[0])[:2] for r in rows}
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(want) < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.personal_data(spark, docs, FOLDER).columns == columns


def test_stages_on_awkward_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    rows = [(5, text, None, None, 1, None), (5, text, None, None, 1, None), (6, text + " x", None, "s", 1, None), (None, text, None, None, None, None), (7, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for data in (docs, docs.limit(0)):
        out = data
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, out, FOLDER)
            assert out.columns == data.columns, name
        ids = [r.doc_id for r in corpus_pipeline.bpe_encoding(spark, out, FOLDER).collect()]
        assert sorted(ids, key=str) == ([5, None] if data is docs else [])


def test_near_copies_of_the_stage(spark):
    """One changed word of 51: 42 of 52 sets of five words are common, but only 44 of 52 of four. Equal ids keep different texts."""
    words = [f"w{k}" for k in range(51)]
    texts = {1: " ".join(words), 2: " ".join([*words[:25], "x", *words[26:]])}
    rows = [*texts.items(), (5, "one text of a kind"), (5, "quite another text here"), (5, "one text of a kind")]
    got = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert Counter(map(tuple, got)) == Counter([(1, texts[1]), *rows[2:4]])


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_lots_and_memory(monkeypatch):
    """Slices keep order, rows and bounds; a worker forgets what the next operator doesn't ask for."""
    texts = ["x" * n for n in (10, 0, 70, 500, 5, 5, 5, 5)] + [None, "é" * 40]
    batch = common.pa.RecordBatch.from_arrays([common.pa.array(range(10)), common.pa.array(texts)], names=["k", "t"])
    monkeypatch.setattr(common, "BYTES_AT_A_TIME", 80)
    monkeypatch.setattr(common, "ROWS_AT_A_TIME", 3)
    cut = [lot.column(0).to_pylist() for lot in common.lots(batch)]
    assert cut == [[0, 1, 2], [3], [4, 5, 6], [7, 8], [9]] and list(common.lots(batch.slice(0, 0))) == []
    assert [lot.column(0).to_pylist() for lot in common.lots(batch.slice(2, 3))] == [[2], [3], [4]]
    with common.only_used():
        common.once("a", list)
        kept = common.once("b", list)
    with common.only_used():
        assert common.once("b", dict) is kept
    assert set(common.memory().entries) == {"b"}


def test_copies_on_a_host_keep_their_text(spark):
    """Copies are one page: neither what they share nor an element that only they have is boilerplate."""
    said = [" ".join(f"s{k}w{i}" for i in range(60)) for k in range(4)]
    body = "".join(f"<p>{x}</p>" for x in said)
    frames = ("<body><article><h1>T</h1>{}</article></body>", "<body><div id='x'>{}</div></body>", "<body><div id='x'><div id='z'>{}</div></div><div id='y'><p>note</p></div></body>")
    rows, want = [], {}
    for h, (frame, copies) in enumerate((f, n) for f in frames for n in (2, 3, 50)):
        for k in range(copies):
            key = 100 * h + k
            rows.append((key, f"http://h{h}.example/{k}", frame.format(body + f"<p>Printed copy {k}</p>")))
            want[key] = "\n\n".join((["T"] if "article" in frame else []) + said + [f"Printed copy {k}"] + (["note"] if "note" in frame else []))
    # A group of copies beside other pages, in an element that those don't have.
    other = [" ".join(f"o{k}w{i}" for i in range(60)) for k in range(6)]
    rows += [(2000 + k, "http://mixed.example/", "<body><section>" + body + f"<p>Printed copy {k}</p></section></body>") for k in range(9)]
    rows += [(2100 + k, "http://mixed.example/", f"<body><div><p>{x}</p></div></body>") for k, x in enumerate(other)]
    want |= {2000 + k: "\n\n".join([*said, f"Printed copy {k}"]) for k in range(9)} | {2100 + k: x for k, x in enumerate(other)}
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want


def test_wrappers_find_what_names_do_not_tell(spark):
    said = [" ".join(f"a{k}w{i}" for i in range(30)) for k in range(5)]
    page = "<body><div class='q1'><p>Home</p><p>Shops near you</p></div><div class='q2'><p>{}</p></div><div class='q3'><p>All rights with us</p></div></body>"
    rows = [(k, "http://a.example/", page.format(x)) for k, x in enumerate(said)]
    got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert {r.page_id: r.text for r in got} == dict(enumerate(said))
    assert all(wrappers.main_text(html, None, []) != said[k] for k, _, html in rows)


@pytest.mark.parametrize("deep", [10, 150, 198, 199, 200, 201, 250, 1000, 20_000])
def test_deep_elements(deep):
    page = "<body><p>top</p>" + "<div>" * deep + "<p>one</p><nav><ul><li>menu<div>more</div>text</li></ul></nav><p>two<section>in</section>three" + "</div>" * deep + "<p>end</p></body>"
    assert wrappers.main_text(page, None, []) == "top\n\none\n\ntwo\n\nin\n\nthree\n\nend"
    page = "<body><p>top</p>" + "<div>" * deep + "<article><h1>one</h1><aside><p>bad</p></aside><p>two</p></article>bad" + "</div>" * deep + "</body>"
    assert wrappers.main_text(page, None, []) == "one\n\ntwo"


def test_formulas_stay():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='tex'>bad</annotation></semantics></math>"
    assert wrappers.main_text(f"<article><p>Let {math} be</p></article>", None, []) == "Let x=2 be"


def test_alignment_against_brute_force():
    """The parts that two pages share are a longest common subsequence of their signatures."""
    rng = random.Random(4)
    part = lambda sig: [sig, False, False, "", 0, False, [], 1, set()]
    for _ in range(200):
        a, b = ([rng.choice("uvw") for _ in range(rng.randrange(6))] for _ in range(2))
        a, b = ([x for k, x in enumerate(side) if k == 0 or side[k - 1] != x] for side in (a, b))
        subsequences = lambda x: {tuple(x[k] for k in range(len(x)) if mask >> k & 1) for mask in range(1 << len(x))}
        longest = max(len(x) for x in subsequences(a) & subsequences(b))
        kept = wrappers.folded
        try:
            wrappers.folded = lambda parts: parts
            got = wrappers.aligned([*map(part, a)], [*map(part, b)])
        finally:
            wrappers.folded = kept
        assert len(got) == len(a) + len(b) - longest and sum(not p[wrappers.OPTIONAL] for p in got) == longest
