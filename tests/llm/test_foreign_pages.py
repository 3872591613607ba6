"""Pages written by hand in the manner of common site builders, none by the rule that the trees are fitted on.

Their class names say little ("css-1q2w3e", "mw-parser-output", "t-4"), and their noise stands in the same elements as their text.
"""

import collections

import pytest

from lumenfold.llm import html_text

P = [
    "The survey observed the field for eleven nights in a row, and each night the seeing was better than a second of arc.",
    "Most of the variables that turned up were known already, but three of them had periods that nobody had measured before.",
    "What remains is to explain the dip in the second half of the cycle, which no model of a single spot reproduces.",
    "Observers who want to join should write to the coordinator before the end of spring, when the next run is planned.",
]
CARD = "<div class='c-9'><a href=/x1>Ten telescopes for beginners</a></div><div class='c-9'><a href=/x2>Why stars twinkle</a></div><div class='c-9'><a href=/x3>Our best photographs</a></div>"

PAGES = {
    "builder": (f"<html><head><title>x</title></head><body><div id=root><div class='css-1a2b'><div class='css-2k'><a href=/>Home</a> <a href=/a>About</a> <a href=/b>Blog</a> <a href=/c>Shop</a></div><div class='css-77'><h1>Eleven nights</h1><div class='css-p'>{P[0]}</div><div class='css-p'>{P[1]}</div><div class='css-p'>{P[2]}</div><div class='css-p'>{P[3]}</div></div><div class='css-55'>{CARD}</div><div class='css-66'><a href=/i>Imprint</a> <a href=/p>Privacy</a> © 2021 Some Site</div></div></div></body></html>", ["Eleven nights", *P]),
    "wiki": (f"<body class='mediawiki'><div id='mw-page-base'></div><div id='content' class='mw-body'><h1 id='firstHeading'>Variable star</h1><div id='bodyContent'><div id='mw-content-text'><div class='mw-parser-output'><p>{P[0]} {P[1]}</p><h2>Dips</h2><p>{P[2]}</p><ul><li>{P[3]}</li></ul></div></div></div></div><div id='mw-navigation'><h2>Navigation menu</h2><div id='p-personal'><ul><li><a href=/t>Talk</a></li><li><a href=/c>Contributions</a></li><li><a href=/l>Log in</a></li></ul></div></div><div id='footer'><ul><li>This page was last edited on 3 May.</li><li><a href=/pp>Privacy policy</a></li></ul></div></body>", ["Variable star", f"{P[0]} {P[1]}", "Dips", *P[2:]]),
    "table layout": (f"<html><body bgcolor=white><table width=760><tr><td colspan=2><img src=logo.gif><font size=5>Star Club</font></td></tr><tr><td width=120><a href=1.htm>News</a><br><a href=2.htm>Links</a><br><a href=3.htm>Guestbook</a><br><a href=4.htm>Members</a></td><td><h2>Spring run</h2><p>{P[0]}<p>{P[1]}<p>{P[2]}<p>{P[3]}</td></tr><tr><td colspan=2><a href=mailto:x@y.z>Webmaster</a> | Best viewed at 800x600</td></tr></table></body></html>", ["Spring run", *P]),
    "news": (f"<body><div class=t-1><ul><li><a href=/w>World</a><li><a href=/s>Science</a><li><a href=/sp>Sport</a></ul></div><div class=t-2>Subscribe now for 1 € <button>Go</button></div><main><h1>Three new periods</h1><p>{P[0]}</p><figure><img src=a.jpg><figcaption>The field in April.</figcaption></figure><p>{P[1]}</p><div class=t-7><a href=/m1>Read also: the best of last year</a></div><p>{P[2]}</p><p>{P[3]}</p></main><div class=t-4><p>anna77: nice one, thanks!</p><p>bob: I doubt that.</p></div><div class=t-9><a href=/x>Terms</a><a href=/y>Contact</a></div></body>", ["Three new periods", P[0], "The field in April.", *P[1:]]),
    "documentation": (f"<body><div class='wy-grid'><div class='wy-nav-side'><ul><li><a href=1>Install</a></li><li><a href=2>Quick start</a></li><li><a href=3>Reference</a></li><li><a href=4>Changes</a></li></ul></div><section class='wy-content-wrap'><div role='main'><h1>Reduction</h1><p>{P[0]}</p><pre>reduce --night 3 --field a</pre><p>{P[1]}</p><p>{P[2]}</p></div><div role='contentinfo'>Built with a theme. © 2020</div></section></div></body>", ["Reduction", P[0], "reduce --night 3 --field a", *P[1:3]]),
}


def score(name):
    page, blocks = PAGES[name]
    got, want = (collections.Counter(t.split()) for t in (html_text.extract([page], html_text.fitted())[0], " ".join(blocks)))
    same = sum((got & want).values())
    return 2 * same / max(1, sum(got.values()) + sum(want.values()))


@pytest.mark.parametrize("name", sorted(PAGES))
def test_foreign_pages_keep_most_of_their_text(name):
    assert score(name) >= 0.9


def test_shipped_trees_are_those_that_are_fitted():
    assert html_text.trained().to_json() == html_text.fitted().to_json()
