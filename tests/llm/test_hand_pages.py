"""Pages written and labelled by hand, in markup that training pages don't copy: lines that begin with + are article text."""

import html
import re

import numpy as np

from millrace.llm import labeller
from millrace.llm.pages import blocks_of

PAGES = [
    """<body><nav><a href=/>-Home</a> <a href=/r>Recipes</a></nav><div class='entry'><h1>+Apple pie</h1><p>+Peel six apples and slice them thinly.</p><ul><li>+200 g flour</li><li>+100 g butter</li></ul>
    <p>+Bake for forty minutes until golden.</p></div><footer>-&copy; 2024 Kitchen</footer></body>""",
    """<body><article><h1>+News of the day</h1><p>+The council met on Monday to discuss the new bridge over the river.</p><p>+Work starts in spring.</p></article><p>-We use cookies. Accept all.</p></body>""",
    """<body><header><div class=logo>-Site</div></header><main><article><header><h1>+On rivers</h1></header><p>+Rivers carve valleys over long ages.</p><p>+They carry silt to the sea.</p><footer>-Filed under nature</footer></article></main><footer>-About us</footer></body>""",
    """<body><article><h1>+Formula</h1><p>+Formula is <math><mi>x</mi><mo>=</mo><mn>5</mn></math> and more.</p></article></body>""",
    """<body><div id="menu-top"><ul><li><a href=/a>-Start</a></li><li><a href=/b>-Themen</a></li></ul></div><main><h1>+Der Wald im Winter</h1><p>+Im Winter ruht der Wald unter dem Schnee.</p><p>+Nur die Meisen rufen.</p></main>
    <div class="cookie-consent"><p>-Wir verwenden Cookies, um Inhalte zu verbessern.</p></div></body>""",
    """<body><div class="wrapper"><div class="content"><article class="hentry"><h1>+Small engines</h1><p>+A small engine needs little oil.</p><aside class="promo"><p>-Buy our oil now.</p></aside><p>+Change it twice a year.</p></article></div>
    <div class="sidebar"><h3>-Popular</h3><ul><li><a href=1>-Large engines</a></li><li><a href=2>-Old engines</a></li></ul></div></div></body>""",
    """<body><section class="story"><h1>+La casa azul</h1><p>+La casa estaba en lo alto de la colina.</p><blockquote>+Nadie sube hasta aquí, dijo ella.</blockquote><p>+El viento movía las puertas.</p></section>
    <section id="comments"><h3>-2 comentarios</h3><div class="comment"><p>-Muy bonito texto.</p></div><div class="comment"><p>-Gracias por compartir.</p></div></section></body>""",
    """<body><header><nav><ul><li><a href=/>-Accueil</a></li><li><a href=/x>-Archives</a></li></ul></nav></header><article><h1>+Le pont neuf</h1><p>+Le pont relie les deux rives depuis quatre siècles.</p><pre>+arche = 12</pre>
    <form action=/s><p>-Votre adresse</p></form></article><footer class="site-footer"><p>-Mentions légales</p></footer></body>""",
    """<body><div class="ad">-Sale ends soon.</div><div class="post-content"><h1>+How bees dance</h1><p>+A bee dances to show the way.</p><h2>+The waggle</h2><p>+The angle tells the direction.</p><p>+The length tells how far.</p></div>
    <div class="related"><ul><li><a href=1>-Ants</a></li><li><a href=2>-Wasps</a></li></ul></div><div class="newsletter"><p>-Get our letter every week.</p></div></body>""",
    """<body><main id="main"><div class="article"><h1>+Salt</h1><p>+Salt was once money.</p></div></main><div role="navigation"><p><a href=1>-Previous</a></p><p><a href=2>-Next</a></p></div></body>""",
    """<body><nav><ul><li><a href=/>-News</a></li></ul></nav><div class="share social">-Share this on your wall</div><article><h1>+Cookies for winter</h1><p>+Cookies keep for weeks in a tin.</p><p>+Share them with friends.</p></article>
    <div class="comments"><div class="comment"><p>-My tin was empty after a day!</p></div></div></body>""",
    """<body><table><tr><td class="body"><h1>+Old page</h1><p>+This page was made long ago, with tables.</p></td></tr></table><div class="banner">-Best viewed at any size</div></body>""",
]


def labelled(page):
    """(blocks, labels): the marks are taken off the texts."""
    found = blocks_of(page)
    marks = [b.text[0] for b in found]
    assert set(marks) <= {"+", "-"}, marks
    clean = blocks_of(re.sub(r"(>)\s*[+-]", r"\1", page))
    assert [b.text[1:] for b in found] == [b.text for b in clean]
    return clean, np.array([m == "+" for m in marks])


def test_hand_labelled_pages():
    net = labeller.trained()
    both = [labelled(p) for p in PAGES]
    told = [s > 0 for s in net.score([labeller.features(b) for b, _ in both])]
    wrong = [(b.text, bool(y)) for (blocks, want), got in zip(both, told) for b, y, g in zip(blocks, want, got) if y != g]
    want, got = np.concatenate([y for _, y in both]), np.concatenate(told)
    hits = (want & got).sum()
    f1 = 2 * hits / (want.sum() + got.sum())
    assert f1 >= 0.95, (f1, wrong)
    # the first four are right throughout
    assert all((y == g).all() for (_, y), g in list(zip(both, told))[:4]), wrong


def test_formulas_are_text():
    page = "<article><p>Mass is <math><mrow><mi>E</mi><mo>/</mo><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation>E/c^2</annotation></math>, &#169; &amp;c.</p></article>"
    assert [b.text for b in blocks_of(page)] == [f"Mass is E/c2, {html.unescape('&copy; &amp;c.')}"]
