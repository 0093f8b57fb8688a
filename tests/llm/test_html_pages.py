"""Whole pages written by hand, with layouts and names that the generator of training pages was not written from."""

import pytest

from gleanery.llm import html_text as H

P = [
    "The ferry left the harbour at noon and reached the island two hours later, in calm weather.",
    "Nobody on board had expected the old lighthouse to be open, yet its door stood wide.",
    "Inside, a keeper in a blue coat was painting the stairs, and he asked everyone to wait.",
]
Q = ["I was there last summer and the door was closed, so you were lucky indeed.", "Great piece! My uncle painted those stairs in 1974, he would love this.", "Which ferry was it? The one from the north pier does not run any more."]
T = "A lighthouse in summer"

PAGES = {
    "comments after a closed article": f"<html><body><article><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p></article><div class='comments'><h3>Comments</h3><p>{Q[0]}</p><p>{Q[1]}</p></div></body></html>",
    "reader comments": f"<body><nav><a href=a>Home</a> <a href=b>News</a></nav><article><h1>{T}</h1><p>{P[0]}</p><p>{P[2]}</p></article><section class='reader-comments'><div class='item'><b>Ann</b><p>{Q[0]}</p></div><div class='item'><b>Bo</b><p>{Q[2]}</p></div></section><footer>© 2020 Island News</footer></body>",
    "comment list": f"<body><main><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p></main><ol class='comment-list'><li class='depth-1'><p>{Q[0]}</p><a href=#>Reply</a></li><li><p>{Q[1]}</p></li></ol></body>",
    "responses": f"<body><div id='content'><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div><div id='responses'><h2>2 Responses</h2><div>Ann says:<p>{Q[0]}</p></div><div>Bo says:<p>{Q[1]}</p></div></div><div id='footer'>Copyright 2019</div></body>",
    "plain divs": f"<body><div><a href=a>Home</a> | <a href=b>Archive</a> | <a href=c>Contact</a></div><div><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div><div>Copyright 2018 Island News. All rights reserved.</div></body>",
    "layout table": f"<body><table width=100%><tr><td><a href=a>Home</a><br><a href=b>Archive</a><br><a href=c>Links</a></td><td><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></td></tr><tr><td>Copyright 2003 Island News</td></tr></table></body>",
    "divs with comments": f"<body><div><a href=a>Home</a> <a href=b>Archive</a></div><div><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p></div><div><h3>Comments</h3><div><b>Ann</b> 3 May 2019<p>{Q[0]}</p><a href=#>Reply</a></div><div><b>Bo</b> 4 May 2019<p>{Q[1]}</p><a href=#>Reply</a></div></div><div>Copyright 2019</div></body>",
    "sidebar and advert": f"<body><header><h2>Island News</h2><nav><ul><li><a href=a>Home</a></li><li><a href=b>Sport</a></li></ul></nav></header><div class='advert'>Buy two boats and get a paddle for free today.</div><main><article><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p></article></main><aside><h3>Popular</h3><ul><li><a href=x>Ten beaches</a></li></ul></aside></body>",
    "cookie notice and forms": f"<body><div class='cookie-consent'><p>We use cookies to make this site better.</p><button>Accept all</button></div><article><h1>{T}</h1><p>{P[0]}</p><blockquote><p>{P[1]}</p></blockquote></article><form action=/s><label>Subscribe to our newsletter</label><button>Send</button></form></body>",
    "lists and captions stay": f"<body><nav><a href=a>Home</a></nav><article><h1>{T}</h1><p>{P[0]}</p><ul><li>{P[1]}</li><li>{P[2]}</li></ul><figure><img src=x><figcaption>The tower seen from the pier at noon.</figcaption></figure></article></body>",
    "teasers": f"<body><article><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p></article><section class='related'><h2>Related posts</h2><div class='card'><a href=x>Ten beaches</a><p>Where the sand is warm.</p></div><div class='card'><a href=y>Old boats</a><p>How they were built.</p></div></section></body>",
    "german comments": f"<body><article><h1>{T}</h1><p>{P[0]}</p><p>{P[2]}</p></article><div id='kommentare'><h3>Kommentare</h3><div class='kommentar'><p>{Q[1]}</p><a href=#>Antworten</a></div></div><footer>Impressum | Datenschutz</footer></body>",
    "discussion thread": f"<body><article><h1>{T}</h1><p>{P[0]}</p><p>{P[1]}</p></article><div class='discussion-thread'><article class='comment'><header>Ann</header><p>{Q[0]}</p></article><article class='comment'><header>Bo</header><p>{Q[2]}</p></article></div></body>",
    "no comments, no menu": f"<p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p>",
}
STAY = {
    "comments after a closed article": [T, P[0], P[1]], "reader comments": [T, P[0], P[2]], "comment list": [T, P[0], P[1]], "responses": [T, *P], "plain divs": [T, *P],
    "layout table": [T, *P], "divs with comments": [T, P[0], P[1]], "sidebar and advert": [T, P[0], P[1]], "cookie notice and forms": [T, P[0], P[1]],
    "lists and captions stay": [T, *P, "The tower seen from the pier at noon."], "teasers": [T, P[0], P[1]], "german comments": [T, P[0], P[2]], "discussion thread": [T, P[0], P[1]],
    "no comments, no menu": P,
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    blocks = H.blocks_of(PAGES[name])
    kept = [b.text for b, p in zip(blocks, H.trained().label([blocks])[0]) if p >= 0.5]
    assert kept == STAY[name], [(round(float(p), 2), b.text[:40]) for b, p in zip(blocks, H.trained().label([blocks])[0])]
