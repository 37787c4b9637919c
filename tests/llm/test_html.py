import numpy as np
from genoframe.llm.html_extract import BlockLabeller, INPUT, blocks_of, extract_main_text, main_text, make_page, padded, trained_labeller


def test_blocks():
    page = """<!DOCTYPE html><title>T</title><script>var t="</p>";</script><style>p{}</style><body><p><b>One &amp; two<br>
      three<p>F&ouml;ur  five<!-- no --><div class="Big-ad x1" id=y>six<span> seven</span></div><a href="a>b">eight</a><td>nine"""
    got = blocks_of(page)
    assert [b.text for b in got] == ["One & two three", "Föur five", "six seven", "eight", "nine"]
    assert ("div", ("big", "ad", "x", "1", "y")) in got[2].path
    assert got[3].linked == 5 and got[0].linked == 0
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> &nbsp; </p><script>x") == []
    assert [b.text for b in blocks_of('a <b title="x')] == ["a"]
    assert len(blocks_of("<p>x" * 30_000)) == 30_000


def test_gradients():
    rng = np.random.default_rng(0)
    model = BlockLabeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = padded([rng.normal(size=(n, INPUT)) for n in (4, 2)])
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        p = model.forward(x, mask)[0]
        return -(np.log(np.where(y == 1, p, 1 - p)) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for k, w in model.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-4, k


def test_held_out_pages():
    model, rng = trained_labeller(), np.random.default_rng(1234)
    right = []
    for _ in range(200):
        page, labels = make_page(rng)
        right += (model.label([blocks_of(page)])[0] == np.array(labels)).tolist()
    assert np.mean(right) > 0.98


PAGE = (
    '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>'
    '<div class="ad">Buy now.</div><article><h1>Title here</h1><p>First   line &amp; more.</p><p>Second line of it.</p></article>'
    '<div class="comments"><p>I do not agree.</p></div><footer>&copy; me</footer></body></html>'
)


def test_head_left_open():
    head = '<html><head><meta charset="x"><title>t</title><style>p{}</style><script>var x</script>'
    for start in ("<body>", "", "<br>", "<custom-tag>"):
        page = f"{head}{start}<p>One two.</p><div>Three</div></html>"
        assert [b.text for b in blocks_of(page)] == ["One two.", "Three"]
    assert [b.text for b in blocks_of(head + " One two.<p>Three")] == ["One two.", "Three"]
    assert main_text([PAGE.replace("</head>", "")], trained_labeller()) == main_text([PAGE], trained_labeller()) != [""]


def test_rows(spark):
    want = "Title here\nFirst line & more.\nSecond line of it."
    assert main_text([PAGE], trained_labeller()) == [want]
    df = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, None), (3, "")], "page_id long, html string").selectExpr("*", "5 as text", "7 as x")
    got = sorted((r.page_id, r.text, r.x) for r in extract_main_text(df).collect())
    assert got == [(1, want, 7), (1, want, 7), (2, "", 7), (3, "", 7)]
    assert extract_main_text(df.limit(0)).count() == 0



#: Layouts written by hand: (page, main blocks, blocks that may be in or out).
PAGES = [
    ("""<!doctype html><html><head><title>Local news</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/w>World</a></li></ul></nav>
<main><article><h1>Bridge reopens after repairs</h1><p class="byline">By A. Reporter</p><p>The old bridge over the river was opened again on Monday after two years of work, the council said.</p>
<p>Engineers replaced every beam and painted the rails. Traffic was light in the morning, but grew towards noon.</p><h2>What comes next</h2><p>A second bridge is planned for the north of the town, and money has been set aside for it.</p></article></main>
<aside><h3>Most read</h3><ul><li><a href=/1>Weather turns cold</a></li><li><a href=/2>Team wins again</a></li></ul></aside><footer><p>Copyright 2024. All rights reserved. <a href=/p>Privacy</a></p></footer></body></html>""",
     ["Bridge reopens after repairs", "The old bridge over the river was opened again on Monday after two years of work, the council said.", "Engineers replaced every beam and painted the rails. Traffic was light in the morning, but grew towards noon.", "What comes next", "A second bridge is planned for the north of the town, and money has been set aside for it."],
     ["By A. Reporter"]),
    ("""<html><body><table width=100%><tr><td class=menu><a href=a>Index</a><br><a href=b>Links</a><br><a href=c>Guestbook</a></td><td><h2>How to keep bees</h2>
<p>Bees need a dry place, water nearby, and flowers from early spring until the first frost. Start with two hives, so that one can help the other.
<p>Open the hive on a warm day without wind. Smoke calms the bees, as they think of fire and eat honey. Work slowly, and look for the queen only if you must.
<p>In autumn the stores must be full. A hive of middle size needs fifteen kilograms of honey to live through the winter.</td></tr></table><hr><small>Last changed 1999. Mail the webmaster.</small></body></html>""",
     ["How to keep bees", "Bees need a dry place, water nearby, and flowers from early spring until the first frost. Start with two hives, so that one can help the other.", "Open the hive on a warm day without wind. Smoke calms the bees, as they think of fire and eat honey. Work slowly, and look for the queen only if you must.", "In autumn the stores must be full. A hive of middle size needs fifteen kilograms of honey to live through the winter."],
     []),
    ("""<html><head><style>.x{}</style></head><body><div id="cookie-banner">We use cookies to improve your visit. <button>Accept all</button></div><div class="header"><div class="logo">The Daily Loaf</div><div class="menu"><a>Bread</a> <a>Cakes</a> <a>Shop</a></div></div>
<div class="wrapper"><div class="post-content"><h1>A plain rye bread</h1><div>Mix the flour with warm water and the sour dough, and leave it under a cloth until the next morning.</div><ul><li>500 g of rye flour, as fresh as you can get it</li><li>400 ml of water</li><li>two spoons of salt</li></ul><div>Knead it well, shape a loaf and bake it for an hour. It is best on the second day, when the crust has softened.</div></div>
<div class="comments"><h3>3 comments</h3><div class="comment">Great recipe, thanks so much!</div><div class="comment">Mine came out flat :(</div></div><form><label>Your name</label><input><label>Your comment</label><textarea></textarea></form></div>
<div class="newsletter">Subscribe to our newsletter and get ten per cent off.</div><script>var a = "<p>no text</p>";</script></body></html>""",
     ["A plain rye bread", "Mix the flour with warm water and the sour dough, and leave it under a cloth until the next morning.", "500 g of rye flour, as fresh as you can get it", "400 ml of water", "two spoons of salt", "Knead it well, shape a loaf and bake it for an hour. It is best on the second day, when the crust has softened."],
     []),
    ("""<html><body><header><a href="/">Institute of Tides</a><nav><a href=r>Research</a><a href=p>People</a></nav></header><section class="story"><h1>Why the tide comes twice</h1><p>The moon draws the water on the near side more strongly than the earth, and the earth more strongly than the water on the far side.</p><blockquote>It is not one wave but two, and the earth turns under them.</blockquote><p>Coasts and basins change the picture: in some bays the tide is as high as a house, in some seas it can hardly be seen.</p><figure><img src=t.png><figcaption>Fig. 1: the two bulges</figcaption></figure><p>Tables of tides are made a year ahead from the movements of moon and sun.</p></section><section class="related"><h2>Related</h2><a href=1>Waves and wind</a><a href=2>Currents</a></section><footer>Contact us | Imprint | Accessibility</footer></body></html>""",
     ["Why the tide comes twice", "The moon draws the water on the near side more strongly than the earth, and the earth more strongly than the water on the far side.", "It is not one wave but two, and the earth turns under them.", "Coasts and basins change the picture: in some bays the tide is as high as a house, in some seas it can hardly be seen.", "Tables of tides are made a year ahead from the movements of moon and sun."],
     ["Fig. 1: the two bulges"]),
    ("""<html><body><div class="topbar">Sign in | Register | Help</div><div class="ad">Sponsored: buy one, get one free!</div><div id="content"><h1>Minutes of the meeting</h1><p>Present were the chair, the treasurer and nine members; two members had sent their excuses.</p><p>The treasurer reported that the accounts were in order and that the roof had been paid for.</p><p>It was agreed to meet again in March.</p></div><div id="sidebar"><p>Opening hours: Monday to Friday, 9 to 5</p><p><a href=m>Become a member</a></p></div><div class="share">Share this: <a>Mail</a> <a>Print</a></div><div class="legal">Terms of use. No part of this page may be copied.</div></body></html>""",
     ["Minutes of the meeting", "Present were the chair, the treasurer and nine members; two members had sent their excuses.", "The treasurer reported that the accounts were in order and that the roof had been paid for.", "It was agreed to meet again in March."],
     []),
    ("""<html><body><div id="nav"><a href=/>Start</a> | <a href=/docs>Manual</a> | <a href=/dl>Downloads</a></div><div class="doc-body"><h1>Setting the clock</h1><div>The clock keeps time while the mains are off, but must be set once after the battery was changed.</div><ol><li>Hold the upper button until the hour blinks</li><li>Turn the wheel to the right hour</li><li>Press the button again and set the minutes</li></ol><div>If the display stays dark, the battery is empty or was put in the wrong way round.</div></div><div class="feedback"><form><label>Was this page helpful?</label><button>Yes</button><button>No</button></form></div><div class="page-footer">Maker of Clocks Ltd. All rights reserved.</div></body></html>""",
     ["Setting the clock", "The clock keeps time while the mains are off, but must be set once after the battery was changed.", "Hold the upper button until the hour blinks", "Turn the wheel to the right hour", "Press the button again and set the minutes", "If the display stays dark, the battery is empty or was put in the wrong way round."],
     []),
    ("""<html><body><header class="masthead"><div class="logo">Notes from the hills</div></header><main><h1>Three days on foot</h1><p>We left the hut before the sun was up. The path was frozen, and nobody spoke for the first hour.</p><h2>What we carried</h2><ul><li>Bread, cheese and dried plums</li><li>A rope of thirty metres</li></ul><p>On the second evening the fog came in from the sea, so we waited under a rock until it was gone.</p><section class="comments"><h3>Responses</h3><p>I was there last year, lovely place!</p></section></main><aside class="widget"><h3>Archive</h3><ul><li><a href=1>March</a></li><li><a href=2>April</a></li></ul></aside><footer>Written by hand. Imprint.</footer></body></html>""",
     ["Three days on foot", "We left the hut before the sun was up. The path was frozen, and nobody spoke for the first hour.", "What we carried", "Bread, cheese and dried plums", "A rope of thirty metres", "On the second evening the fog came in from the sea, so we waited under a rock until it was gone."],
     []),
]


def test_layouts_written_by_hand():
    """None is drawn as the training pages are: nothing but main text is kept, and most of it."""
    model = trained_labeller()
    right = extra = lost = 0
    for (_, want, free), got in zip(PAGES, main_text([p for p, _, _ in PAGES], model)):
        have = [x for x in got.split("\n") if x and x not in free]
        right += sum(x in want for x in have)
        extra += sum(x not in want for x in have)
        lost += sum(x not in have for x in want)
    assert 2 * right / (2 * right + extra + lost) > 0.9 and extra <= 1


def steps(page):
    """Lines of Python that the parser runs: work that does not depend on the machine."""
    import sys

    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "line"
        return count

    old = sys.gettrace()
    sys.settrace(count)
    try:
        blocks_of(page)
    finally:
        sys.settrace(old)
    return n


def test_odd_pages_take_linear_work():
    for make in (lambda n: "<div>x" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<p>x</q>" * n, lambda n: "<i>" * n + "</b>x<p>" * n):
        assert steps(make(800)) < 4.4 * steps(make(200))


def test_deep_and_unclosed_pages():
    got = blocks_of("<div class=a>x" * 40_000)
    assert len(got) == 40_000 and sum(1 for _ in got[-1].path) == 40_000
    assert [b.text for b in blocks_of("one <" + "a" * 400_000)] == ["one"]
    assert [b.text for b in blocks_of("<b>" * 20_000 + "</i>" * 20_000 + "end")] == ["end"]
    assert [b.text for b in blocks_of("<div><p>one</section>two</div>three")] == ["one", "two", "three"]
