"""Pages that know their main text, built apart from the operator's own layouts: whole sites with one
design each, random or generated class names, tables, cards, widgets and threads; and pages by hand."""

import random

WORDS = (
    "harbour council winter bridge market station engine garden theatre mountain letter signal window river "
    "budget teacher captain festival journey museum harvest village orchestra railway island lantern meadow "
    "the a of and to in was for that with from had were which about after before between during through said"
).split()


class Site:
    """One design: an order of parts, and markup in which nothing says what a part is for."""

    def __init__(self, seed, landmarks=False):
        self.r = random.Random(seed)
        self.landmarks = landmarks
        self.classes = {}
        self.shell = self.r.choice((1, 1, 2, 3))
        self.para = self.r.choice(("p", "p", "p", "div"))
        self.deep = self.r.randint(0, 3)
        self.first = self.r.sample(("brand", "menu", "search", "notice", "crumbs"), self.r.randint(2, 4))
        self.side = self.r.random() < 0.5
        self.last = self.r.sample(("related", "comments", "letter", "links", "legal"), self.r.randint(2, 5))
        self.byline = self.r.random() < 0.5
        self.inner_ad = self.r.random() < 0.4

    def name(self, part):
        if part not in self.classes:
            letters = "abcdefghijklmnopqrstuvwxyz0123456789"
            self.classes[part] = self.r.choice(("css-", "sc-", "_", "")) + "".join(self.r.choices(letters, k=self.r.randint(3, 8)))
        return self.classes[part]

    def tag(self, part, inner, tag="div"):
        return f'<{tag} class="{self.name(part)}">{inner}</{tag}>'

    def words(self, low, high):
        return " ".join(self.r.choices(WORDS, k=self.r.randint(low, high)))

    def sentence(self, low=6, high=18):
        return self.words(low, high).capitalize() + "."

    def paragraph(self, low=2, high=6):
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def part(self, kind):
        r = self.r
        if kind == "brand":
            return self.tag(kind, f"<a href=/>{self.words(1, 2).title()}</a>")
        if kind in ("menu", "links", "crumbs"):
            n = {"menu": (4, 9), "links": (5, 15), "crumbs": (2, 4)}[kind]
            links = [f'<a href="/{i}">{self.words(1, 3).title()}</a>' for i in range(r.randint(*n))]
            if kind == "crumbs" or r.random() < 0.3:
                return self.tag(kind, " ".join(f"<span>{x}</span>" for x in links))
            return self.tag(kind, "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>")
        if kind == "search":
            return self.tag(kind, f'<form><input name="q" placeholder="Search"><button>{self.words(1, 1)}</button></form>')
        if kind == "notice":
            return self.tag(kind, f"<span>{self.sentence(8, 16)}</span><button>Accept</button> <a href=#>More</a>")
        if kind == "related":
            cards = [self.tag("card", f"<a href=/{i}><h4>{self.words(4, 9).capitalize()}</h4></a><span>{r.randint(1, 28)} May</span>") for i in range(r.randint(3, 6))]
            return self.tag(kind, f"<h3>{self.words(1, 3).title()}</h3>" + "".join(cards))
        if kind == "comments":
            each = [self.tag("comment", f"<b>{self.words(1, 1)}</b> <span>{r.randint(1, 59)} minutes ago</span><div>{self.sentence(4, 20)}</div><a href=#>Reply</a>") for _ in range(r.randint(1, 6))]
            return self.tag(kind, f"<h3>{r.randint(2, 90)} {self.words(1, 1)}</h3>" + "".join(each))
        if kind == "letter":
            return self.tag(kind, f"<div>{self.sentence(5, 10)}</div><form><input type=email><button>Join</button></form>")
        return self.tag(kind, f"<span>© 2024 {self.words(2, 4).title()}</span> <a href=#>Terms</a> <a href=#>Privacy</a>")

    def page(self):
        """(html, blocks of the main text)."""
        r = self.r
        main = []
        body = ""
        title = self.words(4, 9).capitalize()
        main.append(title)
        body += f"<h1>{title}</h1>"
        if self.byline:
            body += self.tag("byline", f"<a href=/a>{self.words(2, 2).title()}</a> <span>{r.randint(1, 28)} May</span>")
        for i in range(r.randint(4, 16)):
            text = self.paragraph()
            main.append(text)
            body += f"<{self.para}>{text}</{self.para}>"
            if r.random() < 0.15:
                text = self.words(2, 5).capitalize()
                main.append(text)
                body += f"<h2>{text}</h2>"
            if r.random() < 0.1:
                items = [self.sentence(4, 12) for _ in range(3)]
                main += items
                body += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
            if self.inner_ad and i == 2:
                body += self.tag("ad", f"<a href=/buy>{self.words(3, 8).capitalize()}</a>")
        for d in range(self.deep):
            body = self.tag(f"deep{d}", body)
        body = self.tag("body", body, "article" if self.landmarks else "div")
        side = self.tag("side", self.part("related")) if self.side else ""
        middle = self.tag("row", side + body if r.random() < 0.5 else body + side) if side else body
        whole = "".join(map(self.part, self.first)) + middle + "".join(map(self.part, self.last))
        for i in range(self.shell):
            whole = self.tag(f"shell{i}", whole)
        return f"<html><head><title>{title}</title></head><body>{whole}</body></html>", main


BY_HAND = [
    (
        """<html><body><div class="css-1x2"><div class="css-9a"><a href="/">The Daily</a></div><ul class="css-77"><li><a
        href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/arts">Arts</a></li><li><a href="/tv">TV</a>
        </li></ul></div><div class="css-9z8y"><h1>Bridge reopens after two years of repairs</h1><p>The old bridge over the river
        reopened to traffic on Monday morning, two years after engineers found cracks in three of its arches.</p><p>Hundreds of
        people walked across it before the first bus, many of them with children who had never seen it open.</p><p>&ldquo;We had
        forgotten how short the way to the market is,&rdquo; said one of them, who lives on the northern bank and runs a shop
        there.</p><p>The repairs cost eleven million, three more than planned, and the council expects them to last for at least
        fifty years.</p></div><div class="css-k2"><div>Subscribe to our letter</div><form><input type="email"><button>Sign up
        </button></form></div><div class="css-p0"><a href="/terms">Terms</a> <a href="/privacy">Privacy</a> <a
        href="/contact">Contact</a></div></body></html>""",
        ["Bridge reopens after", "The old bridge", "Hundreds of people", "We had forgotten", "The repairs cost"],
        ["The Daily", "Sport", "Subscribe", "Sign up", "Terms"],
    ),
    (
        """<body><table width="100%"><tr><td><a href="a">Home</a><br><a href="b">Archive</a><br><a href="c">Links</a><br>
        <a href="d">Guestbook</a></td><td><font size="5">How to prune an apple tree</font><p>Prune in late winter, while the tree
        is dormant and its shape can be seen without leaves in the way.<p>Take out dead and crossing branches first, cutting just
        outside the collar where the branch meets the trunk, and never more than a fifth of the crown in one year.<p>Leave the
        short spurs alone: they carry the blossom, and with it the apples of the next autumn.<p>Clean the saw between trees, as
        canker travels on the blade and an orchard can be lost to it within a few seasons.</td></tr></table><center><a
        href="e">Back to top</a> | <a href="f">Mail me</a></center></body>""",
        ["How to prune", "Prune in late winter", "Take out dead", "Leave the short", "Clean the saw"],
        ["Archive", "Guestbook", "Back to top", "Mail me"],
    ),
    (
        """<html><body><div id="x1"><div id="x2"><a href="/">Blog of a sailor</a> <a href="/about">About</a></div><div id="x3"><h2>
        Across the strait in a small boat</h2><div>We left at four in the morning with the tide and a light wind from the south,
        hoping to be across before the ferries began.</div><div>By six the wind had died, and we rowed in turns for two hours
        under a sun that was already hot, with the coast behind us not getting any smaller.</div><div>Then a breeze came up from
        the west, the sail filled, and at noon we tied up in the harbour on the other side, tired and very pleased.</div></div>
        <div id="disqus_thread"><h3>3 replies</h3><div><b>tom</b> <span>2 days ago</span><div>Nice one, did the same in June!
        </div><a href="#">Reply</a></div><div><b>ana</b> <span>1 day ago</span><div>Which boat is it?</div><a href="#">Reply</a>
        </div><div><b>kim</b> <span>5 hours ago</span><div>Lovely.</div><a href="#">Reply</a></div></div></div></body></html>""",
        ["Across the strait", "We left at four", "By six the wind", "Then a breeze"],
        ["About", "Nice one", "Which boat", "Lovely", "Reply"],
    ),
]
