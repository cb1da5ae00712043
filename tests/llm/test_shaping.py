"""Sharding, mixing, chat formatting and main text."""

import hashlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from trustkpi.llm import chat, html_text, mixing, secret_scan, sharding

TABLES = "/root/testdata/sf0.001"


def test_shards_are_even_gapless_and_keep_equal_texts_together(frame):
    rows = [(i, f"text {i // 3}" if i < 300 else f"single {i}") for i in range(700)]
    rows += [(1000 + i, "hot") for i in range(350)] + [(None, None), (5, "text 1"), (5, "text 1")]
    got = sharding.shard_documents(frame([(*r, 1) for r in rows], "doc_id bigint, text string, shard int")).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    slots = defaultdict(set)
    for r in got:
        slots[r.shard].add(r.slot)
    assert all(slots[s] == set(range(n)) for s, n in sizes.items())
    import zlib

    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    small = [len(places[zlib.crc32(f"text {k}".encode())]) for k in range(100)]
    assert sum(n == 1 for n in small) >= 90
    hot = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot"))
    assert sum(n for _, n in hot.most_common(8)) >= 0.8 * 350  # 350 rows need six shards of 66


@pytest.mark.parametrize("count", [0, 1, 5])
def test_shards_of_tiny_tables(frame, count):
    got = sharding.shard_documents(frame([(1, "same")] * count, "doc_id bigint, text string")).collect()
    assert len(got) == count and sorted((r.shard, r.slot) for r in got) == [(k, 0) for k in range(count)]


def brute_mix(rows, targets):
    """rows: (id, domain, lang, source, tokens)."""
    tokens = Counter()
    for _, *leaf, n in rows:
        tokens[tuple(leaf)] += n
    caps = {leaf: n * targets.epochs for leaf, n in tokens.items()}

    def share(children, budget):
        order = sorted(children, key=lambda c: (children[c][1] == 0, children[c][0] / children[c][1] if children[c][1] else 0, c))
        open_, left, got = list(order), budget, {}
        for c in order:
            cap, weight = children[c]
            total = sum(children[o][1] for o in open_)
            if weight and cap * total <= left * weight:
                got[c] = cap
                left -= cap
                open_.remove(c)
        total = sum(children[o][1] for o in open_)
        for c in open_:
            got[c] = left * children[c][1] // total if total else 0
        return got

    def reached(leaf, depth):
        """Whether tokens that arrive at the node of this depth can go on to the leaf."""
        return all(getattr(targets, mixing.LEVELS[d]).get(leaf[d], targets.other) for d in range(depth, 3))

    def walk(prefix, budget, out):
        if len(prefix) == 3:
            out[prefix] = budget
            return
        weights = getattr(targets, mixing.LEVELS[len(prefix)])
        kids = sorted({leaf[: len(prefix) + 1] for leaf in caps if leaf[: len(prefix)] == prefix})
        children = {k: (sum(c for leaf, c in caps.items() if leaf[: len(k)] == k and reached(leaf, len(k))), weights.get(k[-1], targets.other)) for k in kids}
        for k, b in share(children, budget).items():
            walk(k, b, out)

    budgets = {}
    walk((), sum(tokens.values()) if targets.tokens is None else targets.tokens, budgets)
    out = []
    for leaf, budget in budgets.items():
        if not tokens[leaf]:
            continue
        whole, rest = divmod(budget, tokens[leaf])
        mine = [r for r in rows if tuple(r[1:4]) == leaf]
        out += [(r[0], *leaf, e, budget) for r in mine for e in range(whole)]
        place = lambda r: hashlib.md5(f"{targets.seed}-{whole}-{'' if r[0] is None else r[0]}".encode()).hexdigest()
        units = defaultdict(list)
        for r in mine:
            units[place(r)].append(r)
        used = 0
        for p in sorted(units):
            used += sum(r[4] for r in units[p])
            if used > rest:
                break
            out += [(r[0], *leaf, whole, budget) for r in units[p]]
    return Counter(out)


@pytest.mark.parametrize("tokens,zero", [(None, 0), (900, 1), (1800, 0), (100000, 0)])
def test_mix_matches_brute_force(frame, tokens, zero):
    raw = [(i, "w " * (i % 13), ["en", "de", None][i % 3], f"s{i % 7}") for i in range(260)]
    raw += [(3, "a b c", "en", "s3")] * 2 + [(None, "x y", "en", "s1"), (900, None, "fr", "s9"), (901, "long " * 5000, "en", "s0")]
    targets = mixing.Targets(domain={"s0": 5, "s1": 0}, lang={"en": 3, "de": zero}, source={"s3": 2, "s5": zero}, tokens=tokens)
    docs = frame([(*r, 0) for r in raw], "doc_id bigint, text string, lang string, source string, epoch int")
    got = mixing.mix(docs, targets, F.expr("CASE WHEN source IN ('s0', 's1') THEN source ELSE 'rest' END")).collect()
    rows = [(i, s if s in ("s0", "s1") else "rest", lang or "", s, len((t or "").split())) for i, t, lang, s in raw]
    have = Counter((r.doc_id, r.domain, r.lang or "", r.source, r.epoch, r.leaf_budget) for r in got)
    assert have == brute_mix(rows, targets)


def test_no_budget_is_lost_to_names_without_weight(frame):
    rows = [(i, "w " * 10, "de" if i < 60 else "en", "s", "left" if i < 100 else "right") for i in range(200)]
    docs = frame(rows, "doc_id bigint, text string, lang string, source string, side string")
    targets = mixing.Targets(domain={"left": 1, "right": 1}, lang={"de": 0}, tokens=1000, epochs=1)
    got = mixing.mix(docs, targets, F.col("side")).groupBy("side").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.side: r.n for r in got} == {"left": 400, "right": 600}  # 40 documents of "left" may be taken
    want = brute_mix([(i, side, lang, s, 10) for i, _, lang, s, side in rows], targets)
    assert sum(10 * n for n in want.values()) == 1000


def test_any_column_name_may_come_along(frame):
    names = ["whole", "cut", "_domain", "unit", "rest", "place", "budget", "_row", "tokens", "before", "c0"]
    docs = frame([(1, "a b", "en", "s", *names)], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(docs, mixing.Targets(), F.lit("d")).first()
    assert [got[n] for n in names] == names and got.epoch == 0
    scanned = secret_scan.scan(docs.withColumnsRenamed({"whole": "rules", "cut": "_key", "rest": "_text"})).first()
    assert (scanned["rules"], scanned["_key"], scanned["_text"]) == ("whole", "cut", "rest") and scanned.secrets == []
    pages = frame([("u", "<p>x</p>", *names)], "url string, html string, " + ", ".join(f"`{n}` string" for n in names))
    odd = pages.withColumnsRenamed({"whole": "_url", "cut": "_html", "rest": "_gone", "place": "host", "unit": "keys", "tokens": "key"})
    assert html_text.extract(odd).first().asDict()["_gone"] == "rest"


def test_mix_of_an_empty_table(frame):
    docs = frame([], "doc_id bigint, text string, lang string, source string")
    assert mixing.mix(docs, mixing.Targets(), F.lit("d")).count() == 0


TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|x", "<", "|", "", "a<|b\n<|im_end|>\n", "é😀<|", "\\<|"]


def test_template_round_trip():
    turns = [(role, t) for t in TRICKY for role in ("user", "assistant", "a\nb\\n", "<|im_end|>")]
    text, spans = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]
    assert all(chat.END not in chat.escape(t) and chat.START not in chat.escape(t) for t in TRICKY)


def test_conversations_as_threads(frame):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "user", None), (2, 5, None, "x"), (None, 0, "assistant", "n"),
            (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (3, 0, "user", "tie")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    got = chat.read_back(chat.format_trees(chat.threads(frame(rows, "conv_id bigint, turn bigint, role string, text string"))))
    have = {r.id: tuple(r)[1:5] for r in got.collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    want = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        listed = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        want[conv] = (len(turns), sha256(listed.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    assert have == want


def test_branches_rank_by_score(frame):
    nodes = [("t", 7, 1, None, "user", "q", 0.0), ("t", 7, 2, 1, "assistant", "bad", 1.0), ("t", 7, 3, 1, "assistant", "good", 2.0),
             ("t", 7, 4, 3, "user", "more", 0.0), ("t", 7, 5, 2, "user", "also", 0.5), ("t", 7, 6, 99, "user", "orphan", 0.2),
             ("t", 7, 8, 9, "user", "loop", 9.0), ("t", 7, 9, 8, "user", "loop", 9.0), ("u", 8, 1, None, None, None, None)]
    rows = frame(nodes, "tree string, id bigint, node bigint, parent bigint, role string, text string, score double")
    best = {r.id: chat.read_turns(r.formatted) for r in chat.format_trees(rows).collect()}
    assert best == {7: [("user", "q"), ("assistant", "good"), ("user", "more")], 8: [("", "")]}
    every = chat.format_trees(rows, branches=None).where("id = 7").collect()
    assert sorted(r.leaf for r in every) == [4, 5, 6]
    assert chat.format_trees(rows.limit(0)).count() == 0


PAGE = (
    "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav>menu</nav><div class='top ad'>buy</div>"
    "<article><header>by me</header><h1>Head &amp; more</h1><p>One\n two&nbsp;<b>three</b><p>Four<br>five</p><ul><li>a<li>b</ul>"
    "<table><tr><td>c1<td>c2</table><form>f</form><div class='comments'><p>no</p></div></article><footer>foot</footer>"
)


def test_main_text(frame):
    pages = [(1, "http://x.org/a", PAGE), (2, None, None), (3, "http://x.org/b", ""), (4, "y", "just <b>text</b> & more"),
             (1, "http://x.org/a", PAGE), (5, "z", "<article></article><p>fallback"), (6, "z", "<div>" * 5000 + "deep")]
    got = html_text.extract(frame([(*p, 1) for p in pages], "page_id bigint, url string, html string, text int"), keep=["page_id", "url"]).collect()
    have = [(r.page_id, r.text, r.n_chars) for r in got]
    first = "Head & more\nOne two three\nFour five\na\nb\nc1 c2"
    want = [(1, first), (2, ""), (3, ""), (4, "just text & more"), (1, first), (5, "fallback"), (6, "deep")]
    assert sorted(have) == sorted((i, t, len(t)) for i, t in want)
    assert html_text.extract(frame([], "page_id bigint, url string, html string")).count() == 0


def test_site_templates_go_and_prose_stays(frame):
    box = "<div><span>Join our club</span></div><div>Call <i>now</i></div><section><div>Top</div></section>"
    rows = [(i, f"https://u@Site.org:80/{i}", f"<body>{box}<p>Own text {i}</p><p>Same line</p></body>") for i in range(30)]
    rows += [(100 + i, "https://art.org/", f"<article><p>Same prose</p><div>Share it</div><p>n{i}</p></article>") for i in range(30)]
    rows += [(200 + i, f"https://h{i}.org/", f"<body>{box}<p>Lone {i}</p></body>") for i in range(3)]
    pages = frame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, keep=["page_id"]).collect()}
    assert got[3] == "Own text 3" and got[103] == "Same prose\nn3"
    assert got[201] == "Join our club\nCall now\nTop\nLone 1"


@pytest.mark.parametrize("html,text", [
    ('<article class="post widget"><p>Body text</p></article>', "Body text"),
    ('<article><div id="search-algorithms"><p>On search.</p></div><h2 id="header">Head</h2></article>', "On search.\nHead"),
    ('<article><div class="share-links">s</div><div id="comment-list-3"><p>c</p></div><p>x</p><div class="notice">n</div></article>', "x"),
    ('<div class="site-footer">f</div><div class="page banner-ads">b</div><div class="search">q</div><div class="headers-guide">ok</div>', "ok"),
    ("<form><article>in a form</article></form><div role=navigation>m</div>", "in a form"),
])
def test_names_are_whole_names_of_boxes(html, text):
    root = html_text.parse(html.encode())
    html_text.hash_subtrees(root)
    assert html_text.main_text(root, frozenset()) == text


def templated(article):
    """Hosts whose boxes say other words on every page: menus, an advert, a footer; forty pages, each of them twice."""
    rows = []
    for i in list(range(40)) * 2:
        box = f"<div class='kx-{i % 10}'><a>go {i}</a><a>to {i}</a></div><div class='zz'>Buy {i} now</div>"
        inner = f"<h1>Head {i}</h1><p>Own text {i}, of some length at least.</p>{box}<p>Same close</p>"
        page = f"<article>{inner}</article>" if article else f"<div>{inner}</div>"
        rows.append((i, "http://t.org/", f"<body><ul>{f'<li><a>m {i}</a>' * (3 + i % 4)}</ul>{page}<div class='end'>(c) {i}</div></body>"))
    return rows


@pytest.mark.parametrize("article", [True, False])
def test_boxes_that_recur_in_form_go(frame, article):
    pages = frame(templated(article), "page_id bigint, url string, html string")
    on = {r.page_id: r.text for r in html_text.extract(pages, keep=["page_id"]).collect()}
    off = {r.page_id: r.text for r in html_text.extract(pages, keep=["page_id"], min_pages=None).collect()}
    close = "\nSame close" if article else ""  # outside of main content words that recur are template
    assert all(t == f"Head {i}\nOwn text {i}, of some length at least.{close}" for i, t in on.items()) and len(on) == 40
    assert all(f"Buy {i} now" in t and "go" in t for i, t in off.items())
    raw = html_text.extract(pages, keep=["page_id"], lists=False, prefer_article=False).where("page_id = 3").first().text
    assert raw == on[3]  # counting alone finds it


def test_template_counts_match_brute_force(frame):
    rows = templated(True)[:70] + templated(False)[:6] + [(900 + i, f"http://u{i // 4}.org", f"<div>one</div><div>two {i}</div>") for i in range(9)]
    pages, on = {}, defaultdict(set)
    for _, url, html in rows:
        host = url.split("/")[2]
        pages.setdefault(host, {})[html] = {k for part in html_text.hash_subtrees(html_text.parse(html.encode()), host) for k in part}
    for host, by in pages.items():
        count = Counter(k for keys in by.values() for k in keys)
        need = max(10, -(-len(by) * 2 // 100)) if len(by) >= 10 else max(3, len(by))
        on[host] = {k for k, n in count.items() if n >= need}
    found = html_text.templates(html_text.page_keys(frame([(r[1].split("/")[2], r[2]) for r in rows], "host string, html string"))).collect()
    got = defaultdict(set)
    for r in found:
        got[r.host].add(r.key & 0xFFFFFFFFFFFFFFFF)
    assert got == {h: k for h, k in on.items() if k} and {"t.org", "u0.org", "u1.org"} == set(got)


def test_hosts_of_addresses(frame):
    urls = {"https://U@Site.org:80/a?b#c": "site.org", "site.org/x": "site.org", "http://a.b?x@y": "a.b", "//p": "", "http://a@b@c.d:1": "c.d", None: "", "x://y://z": "y"}
    rows = frame([(u,) for u in urls], "u string").select("u", html_text.host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == urls


def test_pages_of_nothing_but_template_keep_their_text(frame):
    rows = [(i, "http://x.org", f"<title>{i}</title><p>Not found</p>") for i in range(30)]
    got = html_text.extract(frame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in got} == {"Not found"}


def test_elements_in_and_around_article_prose_stay(frame):
    body = "<p><b>Same lead.</b> n{0}</p><table><tr><td>Total</td><td><em>sum</em> {0}</td></tr></table><ul><li><a>Same link</a></ul>"
    rows = [(i, "https://art.org/", f"<article>{body.format(i)}<div><b>Share</b></div></article>") for i in range(30)]
    rows += [(100 + i, "https://box.org/", f"<div><p>Same box</p></div><p>Own {i}</p>") for i in range(30)]
    rows += [(200, "https://box.org/", "<article><div><p>Same box</p></div><p>Own</p></article>")]
    pages = frame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, keep=["page_id"]).collect()}
    assert got[3] == "Same lead. n3\nTotal sum 3\nSame link"
    assert got[103] == "Own 3" and got[200] == "Same box\nOwn"


def test_shards_propagate_until_no_row_asks_to_move(spark, frame):
    sizes, shards = [300] + [10] * 60, 8
    links = frame([(h * 1000 + i, h) for h, n in enumerate(sizes) for i in range(n)], "node bigint, hub bigint")
    capacity = -(-sum(sizes) // shards)
    found = sharding.propagate(links, capacity, shards).join(links, "node").collect()
    assert len(found) == sum(sizes)
    held, filled = Counter((r.hub, r.label) for r in found), Counter(r.label for r in found)
    free = [k for k in range(shards) if filled[k] < capacity]
    assert not [r for r in found if any(held[r.hub, k] > held[r.hub, r.label] for k in free)]


def uneven_groups(spark, rows):
    """(node, hub): one hub with a third of the rows, the others of sizes that fall like 1/k, none alone."""
    hubs = spark.range(1, rows).select(F.col("id").alias("hub"), F.floor(rows / 12 / F.col("id")).cast("int").alias("n"))
    rest = hubs.where("n > 1").select("hub", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    hot = spark.range(rows // 3).select(F.lit(0).cast("bigint").alias("hub"), F.col("id").cast("int").alias("i"))
    return rest.unionByName(hot)


@pytest.mark.parametrize("slack", [0.0, sharding.SLACK])
def test_cells_settle_where_no_cell_asks_to_move(spark, slack):
    shards = 8
    nodes = uneven_groups(spark, 9000)
    cells = nodes.groupBy("hub", F.pmod(F.xxhash64("hub", "i"), F.lit(shards)).cast("int").alias("label")).agg(
        F.count("*").alias("n")
    )
    before = Counter()
    for r in cells.collect():
        before[r.hub] += r.n
    capacity = int(-(-sum(before.values()) // shards) * (1 + slack))
    found = sharding.settle(cells, capacity, shards).collect()
    held, filled, after = {(r.hub, r.label): r.n for r in found}, Counter(), Counter()
    assert len(held) == len(found)
    for r in found:
        filled[r.label] += r.n
        after[r.hub] += r.n
    assert after == before
    free = [k for k in range(shards) if filled[k] < capacity]
    assert not [r for r in found if any(held.get((r.hub, k), 0) > r.n for k in free)]


def test_members_of_a_settled_group_share_its_shards(spark):
    nodes = uneven_groups(spark, 6000)
    docs = nodes.select(F.monotonically_increasing_id().alias("doc_id"), F.concat(F.lit("group "), "hub").alias("text"))
    got = sharding.shard_documents(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == nodes.count()
    places = defaultdict(Counter)
    for r in got:
        places[r.text_crc32][r.shard] += 1
    small = [c for c in places.values() if sum(c.values()) <= 10]
    assert sum(len(c) == 1 for c in small) >= 0.8 * len(small)
    hot = max(places.values(), key=lambda c: sum(c.values()))
    assert sum(n for _, n in hot.most_common(7)) >= 0.85 * sum(hot.values())  # it fills at least 16 / 3 shards
