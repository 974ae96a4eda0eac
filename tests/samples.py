"""Three pages made for the tests: a list of offers and the pages of its two goods."""

LIST = """<html><head><title>Living room</title>
<meta property="og:site_name" content="Loom &amp; Lumen"><meta charset=utf-8></head><body>
<h1>Living room</h1>
<ol class="rows">
<li class="offer" id="o1"><h3>Arc lamp</h3><figure><img src="pics/arc.webp" alt="Arc lamp, brass"></figure>
<b>&euro; 75.50</b> <a href="items/arc-lamp">see more</a>
<div>Brass floor lamp with a dimmer and a marble foot.</div>
<li class="offer" id="o2"><h3>Wool rug</h3><div>Woven by hand in two colours, washable.</div>
<img data-src="pics/rug.webp" src="pics/rug.webp" title="Rug in grey"><b>1,240.00 EUR</b> <a href="items/wool-rug#top">see more</a></li>
</ol></body></html>"""

LAMP = """<html><head><title>Arc lamp | Loom &amp; Lumen</title>
<script type="application/ld+json">{"@context":"https://schema.org","@graph":[
{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"item":{"@id":"/shop"}}]},
{"@type":"Product","manufacturer":{"name":"Lumen Works"},"mpn":"LW-3","productID":"ARC-75",
"offers":[{"@type":"Offer","availability":"PreOrder"},{"@type":"AggregateOffer","lowPrice":75.5}]}]}</script>
</head><body><h2>Arc lamp</h2><p>Reach: 180 cm</p></body></html>"""

RUG = """<html><head><title>Wool rug | Loom &amp; Lumen</title></head><body><h2>Wool rug</h2>
<table><tr><th>Item no<td>RUG-204<tr><th>Size<td>2 by 3 m</table><p>Yours for 1,240.00 EUR</p></body></html>"""

PAGES = [
    (1, "http://h/shop/list.html", LIST),
    (2, "http://h/shop/items/arc-lamp", LAMP),
    (3, "http://h/shop/items/wool-rug", RUG),
]
