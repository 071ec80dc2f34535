"""Generated pages whose main text is known, to train the HTML extraction on.

Every page is put together from a site frame (menus, notices, adverts, sidebars, comments, footer) and an
article; ``data-truth`` marks what is wanted (1) and what isn't (0).
"""

from __future__ import annotations

import random

_SYLLABLES = "an en the ti on re la de ver sch ou ai men to es qu ra lo mi ka ne be st ing al or us".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int = 1, high: int = 22) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.1:
            words = [w + self.r.choice(["&amp;&amp;", "***", "%%", "###"]) for w in words]
        return " ".join(words).capitalize() + "."

    def title(self) -> str:
        """A heading: a sentence without its stop, or cut short anywhere."""
        text = self.sentence(1, 14)
        return text if self.r.random() < 0.2 else text[: self.r.choice([60, 60, 40, 25, 500])].rstrip(".& ")

    def prose(self, low: int = 1, high: int = 9) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.15:
            out += f' <a href="/{self.word()}">{self.word()}</a> ' + self.sentence()
        if self.r.random() < 0.1:
            out = f"<em>{self.word()}</em> " + out
        return out

    def attrs(self, *names: str) -> str:
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += " " + self.word()
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{self.word()} {name}"', f" class='{name}-wrap'"])

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items)

    # ------------------------------------------------------------ what isn't wanted

    def menu(self) -> str:
        return self.r.choice([f"<nav{{}}>{self.links()}</nav>", f"<div{self.attrs('menu', 'nav', 'navigation', 'breadcrumb', 'topbar')}{{}}>{self.links()}</div>", f'<div role="navigation"{{}}>{self.links()}</div>']).format(' data-truth="0"')

    def head(self) -> str:
        inner = f"<p>{self.sentence(1, 6)}</p>" if self.r.random() < 0.5 else f'<a href="/">{self.word()}</a>'
        inner += self.menu() if self.r.random() < 0.5 else ""
        return self.r.choice([f'<header data-truth="0">{inner}</header>', f'<div{self.attrs("header", "masthead", "banner")} data-truth="0">{inner}</div>', f'<header role="banner" data-truth="0"><h1>{self.word()}</h1>{inner}</header>'])

    def advert(self) -> str:
        inner = self.prose(1, 3) if self.r.random() < 0.7 else f'<a href="http://{self.word()}.example">{self.sentence(2, 8)}</a>'
        inner = f"<p>{inner}</p>" if self.r.random() < 0.4 else inner
        return self.r.choice([f'<div{self.attrs("ad", "ads", "advert", "sponsored", "promo")} data-truth="0">{inner}</div>', f'<aside{self.attrs("ad", "advertisement")} data-truth="0">{inner}</aside>', f'<section{self.attrs("promo", "sponsor")} data-truth="0">{inner}</section>'])

    def notice(self) -> str:
        inner = f"<p>{self.prose(1, 3)}</p>" if self.r.random() < 0.6 else self.prose(1, 3)
        button = f"<button>{self.word()}</button>" if self.r.random() < 0.6 else ""
        return self.r.choice([f'<div{self.attrs("cookie", "consent", "notice", "alert", "popup", "disclaimer")} data-truth="0">{inner}{button}</div>', f'<div role="dialog" data-truth="0">{inner}{button}</div>', f'<dialog open data-truth="0">{inner}{button}</dialog>'])

    def sidebar(self) -> str:
        inner = "".join(self.r.choice([f"<h3>{self.word()}</h3>{self.links(2, 6)}", f"<p>{self.prose(1, 3)}</p>", f"<div{self.attrs('widget')}><h4>{self.word()}</h4>{self.links(2, 5)}</div>"]) for _ in range(self.r.randint(1, 4)))
        return self.r.choice([f'<aside data-truth="0">{inner}</aside>', f'<div{self.attrs("sidebar", "widgets", "rail", "secondary")} data-truth="0">{inner}</div>', f'<aside{self.attrs("sidebar")} data-truth="0">{inner}</aside>'])

    def form(self) -> str:
        inner = f'<label>{self.word()}</label><input name="{self.word()}"><button>{self.word()}</button>'
        inner = f"<p>{self.sentence(2, 12)}</p>" * (self.r.random() < 0.5) + inner
        return self.r.choice([f'<form data-truth="0">{inner}</form>', f'<div{self.attrs("newsletter", "subscribe", "login", "search")} data-truth="0"><form>{inner}</form></div>'])

    def comments(self) -> str:
        tag = self.r.choice(["div", "li", "article"])
        each = "".join(f'<{tag}{self.attrs("comment", "reply")}><span class="author">{self.word()}</span><p>{self.prose(1, 5)}</p></{tag}>' for _ in range(self.r.randint(1, 5)))
        each = f"<ol>{each}</ol>" if tag == "li" else each
        inner = f"<h3>{self.sentence(1, 3)}</h3>{each}" + (self.form() if self.r.random() < 0.4 else "")
        return self.r.choice([f'<section id="comments" data-truth="0">{inner}</section>', f'<div{self.attrs("comments", "discussion", "commentlist")} data-truth="0">{inner}</div>'])

    def related(self) -> str:
        return f'<div{self.attrs("related", "share", "social", "recommended", "popular")} data-truth="0"><h4>{self.word()}</h4>{self.links(2, 6)}</div>'

    def foot(self) -> str:
        inner = f"&copy; {self.word()}.example.com &middot; {self.prose(1, 3)}"
        inner = f"<p>{inner}</p>" if self.r.random() < 0.4 else inner
        inner += self.links(2, 5) if self.r.random() < 0.4 else ""
        return self.r.choice([f'<footer data-truth="0">{inner}</footer>', f'<footer data-truth="0">{inner}</footer>', f'<div{self.attrs("footer", "copyright")} data-truth="0">{inner}</div>'])

    # ------------------------------------------------------------ what is

    def paragraph(self) -> str:
        text = self.prose(1, 9) if self.r.random() < 0.85 else self.sentence(1, 2)
        return self.r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<p><b>{text}</b></p>"])

    def article(self) -> str:
        title = self.title()
        parts = []
        heading = f"<h1>{title}</h1>"
        roll = self.r.random()
        if roll < 0.15:
            heading = f"<header{self.attrs('entry', 'post', 'title')}>{heading}</header>"
        elif roll < 0.25:
            heading = f"<h2>{title}</h2>"
        elif roll < 0.3:
            heading = ""
        parts.append(heading)
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14, 25]) if self.r.random() < 0.97 else self.r.randint(65, 160)):
            roll = self.r.random()
            if roll < 0.82:
                parts.append(self.paragraph())
            elif roll < 0.87:
                parts.append(f"<h2>{self.title()}</h2>")
            elif roll < 0.90:
                parts.append("<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif roll < 0.92:
                parts.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif roll < 0.94:
                parts.append(f'<figure><img src="{self.word()}.png"><figcaption>{self.sentence(2, 10)}</figcaption></figure>')
            elif roll < 0.955:
                parts.append("<table><tr>" + "".join(f"<td>{self.sentence(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif roll < 0.965:
                parts.append(f"<div>{self.prose(2, 5)}</div>")
            elif roll < 0.975:
                parts.append(self.advert())
            elif roll < 0.985:
                parts.append(self.related())
            else:
                parts.append(self.form())
        if self.r.random() < 0.15:
            parts.append(self.comments())
        inner = "".join(parts)
        kind = self.r.random()
        if kind < 0.5:
            return f'<article data-truth="1">{inner}</article>'
        if kind < 0.6:
            return f'<main><article{self.attrs("post", "entry")} data-truth="1">{inner}</article></main>'
        if kind < 0.7:
            return f'<main data-truth="1">{inner}</main>'
        if kind < 0.9:
            return f'<div{self.attrs("content", "post", "entry-content", "story", "article-body")} data-truth="1">{inner}</div>'
        return f'<div data-truth="1">{inner}</div>'

    def page(self) -> str:
        chance = lambda p: self.r.random() < p
        before = [self.menu() if chance(0.7) else "", self.head() if chance(0.4) else "", self.notice() if chance(0.3) else "", self.advert() if chance(0.45) else "", self.form() if chance(0.1) else ""]
        self.r.shuffle(before)
        after = [self.comments() if chance(0.3) else "", self.related() if chance(0.25) else "", self.sidebar() if chance(0.35) else "", self.advert() if chance(0.2) else "", self.notice() if chance(0.1) else ""]
        self.r.shuffle(after)
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            body = f"<div{self.attrs('page', 'container', 'wrapper', 'site')}>{body}</div>"
        body += self.foot() if chance(0.85) else ""
        end = "</body></html>" if chance(0.85) else ""
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 6)}</title><style>p{{}}</style></head><body>{body}{end}"


def generated_pages(n: int, seed: int = 11) -> list[str]:
    """``n`` pages, the same for the same seed."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
