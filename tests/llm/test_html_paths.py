"""Path ratios decide on pages that name an article, too."""

import math
import os
import re

from conftest import DATA

from scoutlake.llm import html

BODY = [f"Paragraph {i} of the body, with quite some text in it. It goes on; and on, for two lines." for i in range(4)]
PLAIN = "".join(f"<p>{t}</p>" for t in BODY)


def test_body_beside_a_named_teaser_is_kept():
    for teaser in ("<article><h3>Teaser</h3><p>Read me.</p></article>", "<div class='post'>Read me.</div>", "<section class=story><p>Read me.</p></section>"):
        got = html.main_text(f"<body><nav><a href=x>Home</a></nav><div><div>{PLAIN}</div></div>{teaser}</body>").split("\n")
        assert [t for t in got if t in BODY] == BODY


def test_names_are_whole_tokens():
    for name in ("content no-sidebar", "no-sidebar", "layout with-banner"):
        assert html.main_text(f"<body><div class='{name}'>{PLAIN}</div></body>") == "\n".join(BODY)
    assert html.main_text(f"<body><div class='sidebar wide'><p>Side.</p></div><div>{PLAIN}</div></body>") == "\n".join(BODY)


def test_an_article_leaves_notices_beside_it_out_and_keeps_its_short_parts():
    page = f"<body><div><p>We use cookies, as all do.</p></div><article><h1>T</h1>{PLAIN}<div><p>Short. But part of it.</p></div><table><tr><td>7</td></tr></table></article></body>"
    assert html.main_text(page) == "\n".join(["T", *BODY, "Short. But part of it.", "7"])


def without_names(page):
    """The page with no class, id or role and no tag that says what it holds."""
    page = re.sub(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page, flags=re.I)
    return re.sub(r"<(/?)(?:article|main|nav|aside|header|footer|section)\b", r"<\1div", page, flags=re.I)


def by_ratios(page):
    """The rule in plain loops: ratios of each path, smoothed over neighbours, fused with the factors, and the threshold."""
    found = html.blocks(page)
    order, rows = [], {}
    for path, factor, text, linked in found:
        if (path, factor) not in rows:
            order.append((path, factor))
        rows.setdefault((path, factor), []).append((max(0, len(text) - linked), len(re.findall(html._MARKS, text)), len(text)))

    def smoothed(k):
        x = [sum(r[k] for r in rows[p]) / len(rows[p]) for p in order]
        return x if len(x) < 3 else [0.25 * x[max(0, i - 1)] + 0.5 * x[i] + 0.25 * x[min(len(x) - 1, i + 1)] for i in range(len(x))]

    named = any(f >= html.IN for _, f in order)
    ratio = [n * math.log2(2 + m) for n, m in zip(smoothed(0), smoothed(1))]
    fused = [r * (f * html.OUT if named and f < html.IN else f) for r, (_, f) in zip(ratio, order)]

    def bar(x):
        mean = sum(x) / len(x)
        return max(max(x) * 0.1, min(mean, math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))))

    least = min(bar(ratio), bar(fused)) if order else 0
    kept = {p for p, f in zip(order, fused) if f > 0 and f >= least}
    beside = {path[:-1] for path, _ in kept}
    for (path, factor), f in zip(order, fused):
        own = sum(r[0] for r in rows[path, factor]) / max(1, sum(r[2] for r in rows[path, factor]))
        near = range(1, len(path)) if factor >= html.IN else (max(0, len(path) - 1), max(0, len(path) - 2))
        if f > 0 and path and path[-1] in html.PARTS and (factor >= html.IN or own >= 0.5) and any(path[:i] in beside for i in near):
            kept.add((path, factor))
    return "\n".join(text for path, factor, text, _ in found if (path, factor) in kept)


def test_the_rule_in_plain_loops_agrees():
    pages = [f"<body><nav><li><a href=x>Home</a></nav><div>{PLAIN}<h2>More</h2><li>one</div><div><p>Short.</p></div></body>", "", "<p>x", f"<main>{PLAIN}</main><div>{PLAIN}</div>"]
    sf = f"{DATA}/sf0.001/pages.parquet"
    if os.path.exists(sf):
        import pyarrow.parquet as pq

        pages += pq.read_table(sf, columns=["html"])["html"].to_pylist()
    for p in pages + [without_names(p) for p in pages]:
        assert html.main_text(p) == by_ratios(p)


def test_pages_without_names_keep_their_text():
    menu = "".join(f"<li><a href=/{i}>Item {i} of the menu</a></li>" for i in range(8))
    page = f"<body><header><h1><a href=/>Site</a></h1></header><nav class=menu><ul>{menu}</ul></nav><article class=content><h2>Title</h2>{PLAIN}<ul><li>a point</li></ul></article><footer><p>&copy; x</p></footer></body>"
    assert html.main_text(page) == "\n".join(["Title", *BODY, "a point"])
    bare = html.main_text(without_names(page)).split("\n")  # a footer's paragraph has the article's path then, and its list the menu's
    assert [t for t in bare if t in ("Title", *BODY)] == ["Title", *BODY] and not any("menu" in t for t in bare)
    sf = f"{DATA}/sf0.01/pages.parquet"
    if os.path.exists(sf):
        import pyarrow.parquet as pq

        same, pages = 0, pq.read_table(sf, columns=["html"])["html"].to_pylist()
        for p in pages:
            whole, bare = html.main_text(p), html.main_text(without_names(p))
            same += whole == bare
            assert not set(whole.split("\n")) - set(bare.split("\n"))  # nothing of the article is lost
        assert same >= 0.8 * len(pages)


def test_an_aside_word_beside_an_article_word_loses_no_text():
    text = "The whole article stands here, in one long sentence of many words, and it goes on, as articles do, to its end."
    for own in sorted(html.ARTICLE_NAMES):
        for other in sorted(html.ASIDE_NAMES):
            for names in (f"{own} {other}", f"{other} {own}"):
                page = f'<html><body><article><h1>Title</h1><div class="{names}"><p>{text}</p><p>{text}</p></div></article><footer>All rights</footer></body></html>'
                got = html.main_text(page)
                assert got.count(text) == 2 and "rights" not in got, names
