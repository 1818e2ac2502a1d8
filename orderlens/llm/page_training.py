"""Labelled pages from which the extraction model is trained.

A few layouts written by hand for this purpose, as they occur on news sites, blogs, shops
and manuals, with and without elements that say what they are. ``data-main`` marks
an element whose whole content is the article; ``data-not`` an element inside or
outside of it that is not. The marks are removed before features are taken.
"""

from __future__ import annotations

_A = (
    "The river rose slowly through the night, and by morning the lower fields were under water. Farmers had moved "
    "their animals to the hills the day before, because the old mill had warned them in time."
)
_B = (
    "Nobody expected the bridge to hold, yet it did. Engineers who came from the city said that its stones had been "
    "laid with more care than any drawing showed, and that it would stand for another hundred years."
)
_C = "We measured the flow at three places, wrote down each number, and compared them with the records of last spring."
_D = "It was over by noon."

# Labelled layouts. Texts repeat, since the model never looks at words of the text itself.
LABELLED_PAGES = [
    # News: everything is named.
    f"""<html><head><title>River</title><style>p{{}}</style><script>var a="<p>";</script></head><body>
    <header><a href="/">Daily</a><nav><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Money</a></li></ul></nav></header>
    <div class="cookie-notice">We use cookies. <a href="/p">More</a> <button>Accept</button></div>
    <main><article data-main><h1>River rises</h1><p class="byline">By A. Writer</p><p>{_A}</p><p>{_B} <a href="/x">See the map</a>.</p>
    <aside data-not class="related"><h3>Related</h3><ul><li><a href="/1">Old flood</a></li><li><a href="/2">New dam</a></li></ul></aside>
    <figure><img src="r.jpg"><figcaption>The bridge at dawn</figcaption></figure><h2>After the flood</h2><p>{_C}</p><blockquote><p>{_D}</p></blockquote></article></main>
    <aside class="sidebar"><h4>Most read</h4><ol><li><a href="/3">One</a></li><li><a href="/4">Two</a></li></ol></aside>
    <section class="comments" id="comments"><h3>3 comments</h3><div class="comment"><b>Jo</b><p>{_C}</p></div><div class="comment"><p>{_D}</p></div>
    <form action="/c"><textarea name="t"></textarea><input type="submit" value="Send"></form></section>
    <footer><p>&copy; Daily</p><ul><li><a href="/i">Imprint</a></li></ul></footer></body></html>""",
    # Blog: divisions with telling names only.
    f"""<html><body><div id="header"><h1><a href="/">My blog</a></h1><div class="menu"><a href="/a">Home</a> <a href="/b">About</a></div></div>
    <div id="wrapper"><div id="content" class="post" data-main><h2 class="title">Water</h2><div class="entry-content"><p>{_A}</p><p>{_D}</p>
    <div data-not class="ad"><p>Buy boots now, cheap and dry.</p></div><p>{_B}</p><ul><li>{_C}</li><li>{_D}</li></ul><table><tr><th>Place</th><td>12</td></tr></table></div>
    <div data-not class="share"><a href="#f">Share</a> <a href="#t">Post</a></div></div>
    <div id="sidebar"><div class="widget"><h3>Archive</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div>
    <div class="widget"><p>{_D} Subscribe to our letter.</p><form><input name="m"></form></div></div></div>
    <div id="respond" class="comment-list"><div class="reply"><p>{_B}</p></div><div class="reply"><p>{_D}</p></div></div>
    <div id="footer"><p>All rights reserved. {_D}</p></div></body></html>""",
    # A page whose divisions have no names.
    f"""<html><body><div><a href="/">Start</a> | <a href="/a">Text</a> | <a href="/b">Contact</a></div>
    <div data-main><h1>Report</h1><p>{_A}</p><p>{_B}</p><p>{_C}</p><p>{_D}</p><pre>x = 1
y = 2</pre></div><div><a href="/1">Imprint</a> <a href="/2">Privacy</a></div></body></html>""",
    # An advert first, unclosed paragraphs and emphasis.
    f"""<html><body><nav><ul><li><a href="/a">{_D}</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad">Cheap boats. {_D}</div>
    <article data-main><h1>Flood</h1><p><b>{_A}<br><p>{_B}</p><p>{_D}</p><p><em>{_C}</em></p></article><footer>&copy; Paper &middot; {_D}</body></html>""",
    # A section page: article within main, with banner, notice and promotion.
    f"""<html><body><div class="banner-ad sponsored"><p>{_D}</p></div><div role="banner"><span>Paper</span></div>
    <main><nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/a">Nature</a></nav>
    <article data-main><header><h1>Stones</h1><p>{_D}</p></header><section><h2>One</h2><p>{_A}</p></section><section><h2>Two</h2><p>{_B}</p><dl><dt>Flow</dt><dd>{_C}</dd></dl></section>
    <div data-not class="newsletter-signup"><p>Get our news by mail. {_D}</p><form><input></form></div><footer data-not><p>Filed under <a href="/n">Nature</a></p></footer></article></main>
    <div class="notice"><p>This site is closing. {_D}</p></div><div class="alert">Please log in.</div>
    <div id="disqus_thread" class="discussion"><article class="comment"><p>{_A}</p></article><article class="comment"><p>{_C}</p></article></div>
    <footer><nav><a href="/1">Jobs</a> <a href="/2">Help</a></nav><p>{_C}</p></footer></body></html>""",
    # A manual with a menu at the side.
    f"""<html><body><div class="topbar"><a href="/">Docs</a><form class="search"><input name="q"><button>Go</button></form></div>
    <div class="container"><div class="toc"><ul><li><a href="#1">Start</a></li><li><a href="#2">Use</a><ul><li><a href="#3">Pipes</a></li></ul></li></ul></div>
    <div class="main" role="main" data-main><h1>Manual</h1><p>{_C}</p><h2>Start</h2><ol><li>{_D}</li><li>{_A}</li></ol><pre><code>open valve</code></pre><h3>Use</h3><p>{_B}</p>
    <table><thead><tr><th>Valve</th><th>State</th></tr></thead><tbody><tr><td>A</td><td>open</td></tr></tbody></table></div></div>
    <div class="promo"><p>{_A}</p></div><div class="pagination"><a href="/p">Back</a> <a href="/n">Next</a></div><div class="copyright">2020 Works</div></body></html>""",
    # A short page.
    f"""<html><head><title>Note</title></head><body><nav><a href="/">Home</a></nav><article data-main><h1>Note</h1><p>{_D}</p></article><footer><p>&copy; me</p></footer></body></html>""",
    # Text directly in the body, with script and noscript.
    f"""<html><body data-main><h1>Plain</h1><p>{_A}</p><script data-not>track("{_D}")</script><noscript data-not><p>Turn on scripts. {_D}</p></noscript><p>{_B}</p><p>{_D}</p></body></html>""",
    # A shop: product text between menus, with reviews by readers.
    f"""<html><body><header class="site-header"><div class="logo"><a href="/">Shop</a></div><ul class="navigation"><li><a href="/a">Boots</a></li><li><a href="/b">Boats</a></li></ul></header>
    <div class="page"><div class="article-body" data-main><h1>Boots</h1><p>{_A}</p><p>{_C}</p><ul><li>{_D}</li><li>Light</li></ul></div>
    <div class="user-comments"><h2>What readers say</h2><p>{_B}</p><p>{_D}</p></div><div class="recommended"><a href="/1">More boots</a><a href="/2">More boats</a></div>
    <div class="advertisement"><p>{_C}</p></div></div><div class="site-footer"><ul><li><a href="/i">Terms</a></li></ul><p>{_D}</p></div></body></html>""",
    # Parts within an article that are not of it.
    f"""<html><body><header><p>Paper</p></header><article class="story" data-main><h1>Dam</h1><p>{_A}</p><div data-not class="ad-slot"><p>{_D} Order today and save.</p></div><p>{_B}</p>
    <div data-not class="advert"><h4>Boats</h4><p>{_C}</p></div><p>{_C}</p><div data-not class="sponsored"><p>{_D}</p></div><p>{_D}</p>
    <section data-not class="comments"><h3>Comments</h3><p>{_D}</p><p>{_A}</p></section></article><footer><p>{_B}</p></footer></body></html>""",
]
