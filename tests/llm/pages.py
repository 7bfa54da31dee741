"""Pages for the extraction test, unlike the ones the classifier is trained on: themes, quirks and their main text."""

from __future__ import annotations

STORIES = [
    (
        "Salt roads of the north",
        [
            "For three centuries the salt of the northern coast was carried south on the backs of mules, along paths that can still be found.",
            "The journey took nine days in summer and up to a month in winter.",
            "Inns along the way kept stables for forty animals & more, and charged by the hoof.",
            "Then came the railway.",
        ],
    ),
    (
        "A short guide to sourdough",
        [
            "A starter is nothing but flour and water in which wild yeast has been allowed to settle and to multiply for a week or two.",
            "Feed it once a day with equal parts of both, and throw away what you do not need.",
            "When it doubles within four hours it is ready to raise a loaf.",
            "Bake hot.",
            "If the crumb is dense, wait longer; if it is sour, wait less.",
        ],
    ),
    (
        "Rechenzentrum zieht um",
        [
            "Das Rechenzentrum der Stadt zieht im Herbst in die alte Spinnerei am Fluss, die seit zwanzig Jahren leer gestanden hat.",
            "Die Abwärme soll das Hallenbad heizen.",
            "Der Rat stimmte dem Plan mit großer Mehrheit zu, obwohl die Kosten im Vergleich zum ersten Entwurf um ein Drittel gestiegen sind.",
        ],
    ),
]
MENU = '<a href="/">Home</a> <a href="/world">World</a> <a href="/sport">Sport</a> <a href="/contact">Contact</a>'


def esc(text: str) -> str:
    return text.replace("&", "&amp;")


def paragraphs(body: list[str], open_="<p>", close="</p>") -> str:
    return "".join(f"{open_}{esc(x)}{close}" for x in body)


def blog(title, body):
    return f'<!doctype html><html><head><title>{title}</title><style>p {{}}</style></head><body class="post-template single-post no-sidebar"><header class="site-header"><div class="logo"><a href="/">My blog</a></div><nav>{MENU}</nav></header><div class="content-area"><article id="post-17" class="post type-post category-news tag-notice has-comments"><h1>{title}</h1>{paragraphs(body)}</article><section id="comments"><h2>Two comments</h2><div class="comment-body"><p>What a lovely text, I read it twice and then sent it to all of my friends at work.</p></div></section></div><footer class="site-footer"><p>Powered by a small machine in a cellar.</p></footer></body></html>'


def stray_quotes(title, body):
    return f"<body><ul class=menu id=it's><li><a href=/>Home</a><li><a href=/w>World</a></ul><div class=a\"b title=\"it's\"><h1 title=it's>{title}</h1>{paragraphs(body, '<p class=x' + chr(39) + 'y>')}</div><div class=footer>Imprint | Contact</div>"


def unclosed(title, body):
    return f"<body><div class=navbar>{MENU}</div><div id=main><h1>{title}</h1>{paragraphs(body, '<p>', '')}</div><div id=footer><p>Copyright 2020 <b>The Company<p>All rights reserved</div>"


def tables(title, body):
    return f"<body><table width=100%><tr><td colspan=2>{MENU}</td></tr><tr><td><a href=/a>Latest</a><br><a href=/b>Archive</a></td><td><h1>{title}</h1>{paragraphs(body)}</td></tr><tr><td colspan=2>&copy; 1999 webmaster</td></tr></table>"


def web_form(title, body):
    return f'<body><form name="aspnetForm" method="post" action="x"><input type=hidden value="a>b"><div class="menu-bar">{MENU}</div><div id="ctl00_main"><h1>{title}</h1>{paragraphs(body)}</div><div class="login-box"><label>User name</label><input><button>Log in</button></div><div id="ctl00_footer">Terms of use | Privacy policy</div></form>'


def divs(title, body):
    return f'<body><div class="header-layout-2 page-wrap"><div class="top-bar"><a href="/">Sign in</a></div><div class="region-content"><h1>{title}</h1>{paragraphs(body, "<div class=para>", "</div>")}</div></div><div class="related-posts"><h3>Related posts</h3><ul><li><a href="/1">The last of the mule drivers</a></li><li><a href="/2">Nine days to market</a></li></ul></div>'


def scripts(title, body):
    return f'<body><script>var t = "<!-- </p>"; if (a < b) {{ document.write("<div>"); }}</script><noscript><p>Please enable JavaScript to see the whole of this page.</p></noscript><div class="cookie-banner"><p>We and our partners use cookies on your device. Do you agree?</p><button>Yes</button></div><main><h1>{title}</h1>{paragraphs(body)}<script>ads("<p>")</script></main><aside><p>Try our new app for free and read all the news on your way to work.</p></aside>'


def adverts(title, body):
    ad = '<div class="advert"><p>Fly to the sun from 49 only, book by Sunday and save on your next holiday.</p></div>'
    return f"<body><nav>{MENU}</nav><article><h1>{title}</h1>{ad.join(paragraphs([x]) for x in body)}</article>{ad}<footer><p>Part of the Example Media Group</p></footer>"


def sections(title, body):
    head, rest = body[0], body[1:]
    return f'<body><div role="navigation">{MENU}</div><main role="main"><header><h1>{title}</h1></header><section class="story-body"><p>{esc(head)}</p></section><section class="story-body"><ul>{paragraphs(rest, "<li>", "</li>")}</ul></section></main><div role="complementary"><h2>Most read</h2><ol><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ol></div><div role="contentinfo"><p>About us and our rules for writers</p></div>'


def deep(title, body):
    return f'<body>{"<div>" * 40}<div class="widget-nav">{MENU}</div><div class="entry"><h1>{title}</h1>{paragraphs(body)}</div>{"</div>" * 40}<div class="newsletter"><p>Subscribe now and get the best of the week every Friday in your inbox.</p></div>'


THEMES = [blog, stray_quotes, unclosed, tables, web_form, divs, scripts, adverts, sections, deep]


def pages() -> list[tuple[str, str, list[str]]]:
    """(theme, page, blocks of its main text): thirty pages."""
    return [(theme.__name__, theme(title, body), [title, *body]) for theme in THEMES for title, body in STORIES]
