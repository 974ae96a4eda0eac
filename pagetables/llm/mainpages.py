"""A small labelled table of text blocks: pages written for this purpose, `keep` marks what belongs to the article, `drop` what
does not although it lies inside."""

PAGES = [
    """<html><head><title>River walk</title><style>a{}</style></head><body><header><a href=/>Town news</a></header>
    <nav><ul><li><a href=/a>Home</a><li><a href=/b>Sport</a><li><a href=/c>About us</a></ul></nav>
    <article keep><h1>New walk along the river opens</h1><p>The path along the northern bank was opened this morning and
    leads from the mill to the old bridge.<p>Short.<p>It took <a href=/x>three years</a> to build and cost less than planned,
    the council said on Monday.</article><aside drop><h3>Most read</h3><ul><li><a href=/1>Rain again</a><li><a href=/2>Bus
    strike</a></ul></aside><footer>&copy; Town news</footer></body></html>""",
    """<body><div id=top-menu><a href=/>Start</a> <a href=/l>Log in</a></div><div class=content keep><h2>Bread without
    kneading</h2><p>Mix flour, water, salt and a little yeast, cover the bowl and wait until tomorrow.<ul><li>500 g of flour
    <li>a pinch of yeast</ul><p>Bake hot.</div><div class=sidebar><p>Our books about baking are in every shop, and now there
    is a new one for beginners too, with eighty recipes.</div><div class=comments><p>I tried this twice and it worked well,
    thank you so much for the clear steps.<p>Mine was flat.</div></body>""",
    """<main><div class="cookie-notice"><p>We use cookies to make this site work and to learn how it is used, please
    agree to that.</div><section keep><h1>Minutes of the meeting</h1><p>Present were all members but one.</p><table><tr><td>
    Item<td>Budget of the coming year<tr><td>Vote<td>Seven to two</table></section><div class="ad">Buy two, pay for one, only
    this week in all our shops.</div><p keep>The next meeting is in May.</p><form><label>Your name</label><input><button>
    Send</button></form></main><footer><p>Contact, imprint and terms of use</footer>""",
    """<html><body><p><a href=/>Back</a> | <a href=/n>Next</a></p><h1 keep>Notes on old maps</h1><p keep>Maps of the valley
    drawn before 1800 show the road on the other side of the river, which puzzled many readers.</p><p keep>The reason is
    plain: there was no bridge yet, and the ford was further north than the mill that everyone knows.</p>
    <blockquote keep>There is no way across but by boat, wrote the surveyor.</blockquote><p><a href=/1>Roads</a> <a
    href=/2>Bridges</a> <a href=/3>Mills</a> <a href=/4>Boats</a></p><p>All rights reserved.</p></body></html>""",
    """<div class="banner promo">Subscribe now and read on all devices for half the price.</div><div class="post" keep>
    <h1>Night train</h1><p>We left at ten.</p><p>Nobody slept, for the carriage was full of singers on their way home from
    the festival.</p><div class="share" drop><a href=#>Share</a><a href=#>Print</a></div><p>At dawn we saw the sea.</p></div>
    <div class="related"><h4>You may also like</h4><a href=/1>Slow boats</a><a href=/2>Fast bikes</a></div>""",
    """<body><nav><a href=/>Home</a></nav><article keep><header><h1>On patience</h1><p>An essay in two parts</p></header>
    <p>One.</p><p>Waiting is a skill, and like all skills it can be learned by anyone who has the time.</p><footer>
    Printed in spring.</footer><section class=comments drop><article><p>What a fine text, I have sent it to all of my friends
    who cannot wait.</article></section></article><div class=newsletter><p>Get our letter each week, it costs nothing and
    you can stop it at any time.</div></body>""",
    """<body><p><a href=/1>Front page</a> <a href=/2>World</a> <a href=/3>Local</a> <a href=/4>Letters</a></p><h1 keep>Library
    opens again</h1><p keep>The old library will be open again from next week on, after two winters of work on its roof and its reading rooms.</p>
    <p keep>Visitors are asked to use the side door until the stairs are done, which will take another month at least.</p>
    <p keep>It is open on Sundays.</p><p><a href=/5>More on this</a> <a href=/6>All letters</a></p><p>Contact us</p></body>""",
    """<table><tr><td><a href=/1>Birds</a><br><a href=/2>Insects of the garden</a><br><a href=/3>Trees</a></td><td keep><h2>The
    wren</h2><p>The wren is among the smallest birds here, and yet its song carries further than that of any other.</p><p>It
    builds several nests, of which <a href=/n>the female</a> chooses one and lines it with feathers and moss.</p><p>It stays
    all year.</p></td></tr><tr><td><a href=/i>Imprint</a></td><td>Last changed in May</td></tr></table>""",
    """<div><a href=/x>Skip to content</a></div><div><a href=/1>Recipes</a> <a href=/2>Tools</a></div><h1 keep>Plum cake</h1><div keep>Plum cake needs
    ripe plums, a yeast dough that has had its time, and nothing else but sugar and some butter.</div><div keep>Serve it
    warm.</div><div><a href=/3>Older</a> <a href=/4>Newer</a></div><div>All rights reserved by the cook</div>""",
    "<body><h1 keep>For sale</h1><p keep>One bike, red.</p><p keep>Ask in the shop.</p></body>",
    "<p keep>Gone fishing until Monday, sorry.</p>", "<div keep>This note is short.</div><div keep>So is the other one.</div>",
    "<h2 keep>Opening hours</h2><div keep>From nine to five.</div><p keep>Closed on Mondays.</p><p><a href=/>Home</a></p><p>Imprint</p>",
    """<nav><a href=/>Start</a></nav><article keep><h1><a href=/s>Sources of the survey</a></h1><p>See <a href=/1>the first
    part</a> and <a href=/2>the second part</a>.<p><a href=/d>All data as a table</a><p>The numbers come from <a
    href=/3>the harbour office</a>, which counts ships by day, and from <a href=/4>the weather service</a> on the hill.<ul>
    <li><a href=/5>Ships by size</a><li><a href=/6>Ships by flag</a>, since 1950<li><a href=/7>Winds</a></ul><p>Thanks to
    <a href=/8>all who helped</a>.</article><footer><a href=/i>Imprint</a></footer>""",
    """<header><a href=/>Home of the club</a></header><main keep><h2>Results</h2><p><a href=/a>Ann</a> won, before <a
    href=/b>Ben</a>.</p><p>Full lists: <a href=/1>women</a>, <a href=/2>men</a>, <a href=/3>youth</a></p><p>The next race is
    on <a href=/r>the first of June</a>, over the same course and with the same rules as in the years before.</p><p><a
    href=/t>Times of all runners</a></p><p>Come all!</p></main><aside><p>Join us, it costs little and keeps you fit.</p>
    </aside>""",
    """<p><a href=/1>Index</a> <a href=/2>Search</a></p><p keep>The bridge at <a href=/m>the mill</a> was built of oak in one
    summer, and for eighty years it carried every cart that went to the market.</p><p><a href=/p>Picture</a></p><p keep>When
    it fell in the flood of that spring, the town asked <a href=/e>an engineer</a> from the coast to plan a new one.</p>
    <p><a href=/q>Another picture</a></p><p keep>He drew two arches of brick, which still stand today and are thought to be
    good for another hundred years.</p><p><a href=/1>Index</a> <a href=/2>Search</a></p><p>Page two of three</p>""",
    """<div><a href=/>Top</a></div><div keep>Three things matter when you buy <a href=/u>a used boat</a>: the hull, the engine
    and the seller, and the last one is the hardest to judge.</div><div><a href=/h>On hulls</a></div><div keep>Walk around
    it, knock at the planks, and ask <a href=/w>someone who knows</a> to look at the wood below the water line.</div><div><a
    href=/>Top</a> <a href=/n>Next</a></div><div>Written by Kim</div>""",
]
