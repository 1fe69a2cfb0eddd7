"""Labelled web pages for the fit of operator 11.

Pages are composed at random from the layouts that sites use: where the article stands, what is around it and inside
it, which elements and which class names say so, and how carelessly tags are closed. ``data-main="1"`` marks an element
whose text belongs to the article, ``data-main="0"`` one inside it that does not. Prose is made of invented words, as
words must not tell article from comment; short phrases that furnish pages (in four languages) are real.
"""

from __future__ import annotations

import random

# Names by which sites mark their regions, and phrases found there.
NAMES = {
    "menu": "nav navbar menu navigation main-menu topnav breadcrumb breadcrumbs tabs toc pagination pager skip-link topbar links categories",
    "header": "header masthead site-header page-header branding top logo topbar hero-banner",
    "footer": "footer site-footer page-footer bottom copyright colophon legal imprint credits",
    "sidebar": "sidebar side widget widget-area rail right-column left-column related recommended most-read trending archive aside tags tag-cloud also-read teaser teasers",
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr notice alert message popup modal overlay paywall subscribe disclaimer warning announcement privacy toast",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner banner-ad ad-slot ad-container adsbygoogle dfp outbrain werbung anzeige publicidad publicite",
    "form": "form newsletter signup sign-up login search searchbox contact-form subscribe-form register survey poll",
    "comments": "comments comment comment-list commentlist responses discussion disqus_thread reader-comments replies user-comments comment-section respond thread reviews kommentare commentaires comentarios",
    "share": "share sharing social social-share toolbar tools actions like-buttons follow icons",
    "main": "content post entry article story body entry-content post-content article-body article-content main text post-body story-body page-content single hentry maincontent prose news blog-post detail",
    "wrap": "page wrapper container wrap outer inner layout grid row col columns site app root center",
}
PHRASES = {
    "menu": "Home|About|Contact|News|Blog|Sports|Politics|Start|Über uns|Kontakt|Accueil|À propos|Inicio|Noticias|Products|Services|FAQ|Help|Archive|Next|Previous|Skip to content|1|2|3",
    "header": "Welcome|The Daily Page|Search|Log in|Sign up|Subscribe|Your source for news|Menu|Anmelden|Connexion",
    "footer": "© 2021 All rights reserved|Copyright 2019|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Contact us|Sitemap|Alle Rechte vorbehalten",
    "sidebar": "Related articles|Most read|Recent posts|Archives|Tags|Categories|You may also like|Trending now|Meistgelesen|Lire aussi|Popular|About the author",
    "notice": "We use cookies to improve your experience|By continuing you accept our cookies|This site uses cookies|Accept all|Reject|Wir verwenden Cookies|Nous utilisons des cookies|Utilizamos cookies|Please enable JavaScript|You have read your last free article|OK|Learn more",
    "advert": "Advertisement|Sponsored|Buy now|Limited offer|Anzeige|Werbung|Publicité|Publicidad|Save 50% today|Click here|Shop now",
    "form": "Your email|Subscribe to our newsletter|Send|Submit|Name|Password|Log in|Search|Get the latest in your inbox|I agree to the terms|Abonnieren|Envoyer",
    "comments": "Comments|Leave a comment|Reply|3 comments|Kommentare|Commentaires|Comentarios|Report|Like|posted 2 days ago|says:|Show more replies|Anonymous",
    "share": "Share|Tweet|Facebook|Twitter|WhatsApp|Email|Print|Like|Follow us|Teilen|Partager|Compartir",
}
# End of the fixed values.


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = ["".join(self.r.choice(x) for x in self.r.choice((("bcdfghklmnprst", "aeiou"), ("aeiouäéñ", "nrstl"), ("st", "aeiou", "nrl")))) for _ in range(30)]

    def some(self, chance: float) -> bool:
        return self.r.random() < chance

    def word(self) -> str:
        return "".join(self.r.choice(self.parts) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self) -> str:
        said = self.r.choice((" ", " ", " ", " ", " | ", ", ")).join(self.word() for _ in range(self.r.choice((1, 2, 4, 7, 10, 14, 20)))) if self.some(0.1) else " ".join(self.word() + ("," if self.some(0.08) else "") for _ in range(self.r.choice((1, 3, 5, 8, 11, 15, 22))))
        return said[:1].upper() + said[1:] + self.r.choice((".", ".", ".", ".", "!", "?", "", ":"))

    def prose(self) -> str:
        if self.some(0.04):
            return " ".join([self.word()] * self.r.randint(5, 60))
        text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 1, 2, 3, 4, 6, 9))))
        if self.some(0.25):
            w = text.split(" ")
            i, tag = self.r.randrange(len(w)), self.r.choice(('a href="/x"', "b", "i", "em", "strong", "span", "code"))
            w[i] = f"<{tag}>{w[i]}</{tag.split()[0]}>"
            text = " ".join(w)
        return text.replace(" ", " &amp; ", 1) if self.some(0.1) else text

    def phrase(self, kind: str) -> str:
        return self.r.choice(PHRASES[kind].split("|")) if self.some(0.5) else self.r.choice((self.word().title(), self.sentence(), self.prose()))

    def named(self, kind: str, tags: tuple[str, ...], inside: str, plain: tuple[str, ...] = ()) -> str:
        """``inside`` in an element of one of ``tags`` with a name of ``kind``, or in one of ``plain`` that may go without."""
        tag = self.r.choice(tags + plain * 2)
        name = self.r.choice(NAMES[kind].split())
        if tag in plain and self.some(0.7):
            attributes = ""
        else:
            also = self.r.choice(("", "", "", f" {self.word()}", f" {self.r.choice(NAMES['wrap'].split())}"))
            attributes = self.r.choice((f' class="{name}{also}"', f' id="{name}"', f' class="{self.word()}-{name}"', f" class='{name}' id=\"{self.word()}\"", f" class={name}"))
        if tag in ("div", "section") and kind in ("menu", "notice") and self.some(0.2):
            attributes += ' role="navigation"' if kind == "menu" else self.r.choice((' role="alert"', ' role="dialog"'))
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def list_of(self, kind: str, n: int) -> str:
        link = lambda: f'<a href="/{self.word()}">{self.phrase(kind) if self.some(0.5) else self.word()}</a>'
        if self.some(0.6):
            return "<ul>" + "".join(f"<li>{link()}" + self.r.choice(("</li>", "</li>", "")) for _ in range(n)) + "</ul>"
        return self.r.choice((" ", " | ", " &middot; ")).join(link() for _ in range(n)) if self.some(0.6) else "".join(f"<div>{link()}</div>" for _ in range(n))

    def text_of(self, kind: str) -> str:
        tag = self.r.choice(("p", "div", "span", "", "h3", "p", "strong"))
        said = self.phrase(kind)
        return f"<{tag}>{said}</{tag}>" if tag else said

    def menu(self) -> str:
        return self.named("menu", ("nav", "div", "ul" if self.some(0.1) else "div"), self.list_of("menu", self.r.randint(2, 10)), ("nav",))

    def header(self) -> str:
        inside = "".join(self.r.choice((self.text_of("header"), f"<h1>{self.word()}</h1>", '<a href="/"><img src="l.png" alt="x"></a>', self.menu(), self.form())) for _ in range(self.r.randint(1, 3)))
        return self.named("header", ("header", "div"), inside, ("header",))

    def footer(self) -> str:
        inside = "".join(self.r.choice((self.text_of("footer"), self.list_of("footer", 4), f"&copy; {self.word()}.example &middot; {self.sentence()}", f"<p>{self.prose()}</p>")) for _ in range(self.r.randint(1, 4)))
        return self.named("footer", ("footer", "div"), inside, ("footer",))

    def sidebar(self) -> str:
        inside = "".join(self.r.choice((self.text_of("sidebar"), f"<h3>{self.phrase('sidebar')}</h3>", self.list_of("sidebar", 4), f"<p>{self.prose()}</p>", self.advert())) for _ in range(self.r.randint(1, 5)))
        return self.named("sidebar", ("aside", "div", "section"), inside, ("aside",))

    def notice(self) -> str:
        inside = self.text_of("notice") + (f"<p>{self.prose()}</p>" if self.some(0.4) else "") + (f"<button>{self.phrase('notice')}</button>" if self.some(0.6) else "")
        return f"<noscript>{inside}</noscript>" if self.some(0.1) else self.named("notice", ("div", "section", "aside", "p" if "<p" not in inside and "<div" not in inside and "<h3" not in inside else "div"), inside)

    def advert(self) -> str:
        inside = self.r.choice((self.sentence(), self.prose(), self.text_of("advert"), f"<p>{self.prose()}</p><a href='/x'>{self.phrase('advert')}</a>"))
        return self.r.choice(("", "", f"<!-- ad {self.r.randint(0, 99)} -->")) + self.named("advert", ("div", "aside", "div", "section"), inside)

    def form(self) -> str:
        fields = "".join(self.r.choice((f"<label>{self.phrase('form')}</label><input name=q>", f"<p>{self.phrase('form')}</p>", "<select><option>a<option>b</select>", "<textarea>x</textarea>", f"<button>{self.phrase('form')}</button>")) for _ in range(self.r.randint(1, 4)))
        form = f"<form action=/s>{fields}</form>"
        return self.named("form", ("div", "section"), f"<h3>{self.phrase('form')}</h3>{form}") if self.some(0.5) else form

    def share(self) -> str:
        return self.named("share", ("div", "ul" if self.some(0.2) else "div"), self.list_of("share", self.r.randint(1, 5)))

    def comments(self) -> str:
        def comment() -> str:
            who = self.r.choice(("", f"<b>{self.word()}</b> says:", f"<div>{self.word()} 2020-01-0{self.r.randint(1, 9)}</div>", f"<cite>{self.word()}</cite>"))
            said = "".join(f"<p>{self.prose()}</p>" for _ in range(self.r.randint(1, 2))) if self.some(0.8) else self.prose()
            return self.named("comments", ("div", "article", "li", "section", "div"), who + said + ("<a href=#>Reply</a>" if self.some(0.3) else ""), ("li",))

        inside = (f"<h{self.r.randint(2, 4)}>{self.phrase('comments')}</h2>" if self.some(0.7) else "") + "".join(comment() for _ in range(self.r.randint(1, 6))) + (self.form() if self.some(0.4) else "")
        return self.named("comments", ("div", "section", "ul" if self.some(0.2) else "div", "aside" if self.some(0.1) else "section"), inside)

    def leaf(self, tag: str, text: str) -> str:
        return f'<{tag} data-main="1">{text}' + ("" if tag in ("p", "li", "dd", "dt") and self.some(0.15) else f"</{tag}>")

    def item(self) -> str:
        leaf, at = self.leaf, self.r.random()
        if at < 0.6:
            return leaf("p", self.prose())
        if at < 0.66:
            return f'<p data-main="1"><b>{self.prose()}<br>'
        if at < 0.74:
            return leaf(self.r.choice(("h2", "h3", "h2", "h4")), self.sentence())
        if at < 0.8:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(leaf("li", self.sentence()) for _ in range(self.r.randint(2, 5))) + f"</{tag}>"
        if at < 0.84:
            return f"<blockquote>{leaf('p', self.prose())}</blockquote>" if self.some(0.6) else leaf("blockquote", self.prose())
        if at < 0.87:
            return f'<figure><img src="a.jpg">{leaf("figcaption", self.sentence())}</figure>'
        if at < 0.9:
            return "<table>" + "".join("<tr>" + "".join(leaf("td", self.word()) for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if at < 0.92:
            return leaf("pre", self.prose())
        if at < 0.94:
            return f"<dl>{leaf('dt', self.word())}{leaf('dd', self.sentence())}</dl>"
        return leaf(self.r.choice(("div", "div", "section")), self.prose())

    def article(self) -> str:
        title = f'<h1 data-main="1">{self.sentence() if self.some(0.7) else self.prose()}</h1>'
        byline = self.leaf(self.r.choice(("p", "div")), f"{self.word()} {self.word()}, 3.4.2020") if self.some(0.15) else ""
        head = f"<header>{title}{byline}</header>" if self.some(0.15) else title + byline if self.some(0.85) else ""
        items = [self.item() for _ in range(self.r.choice((0, 1, 2, 4, 7, 10, 16, 25)))]
        for _ in range(self.r.choice((0, 0, 1, 2, 3))):
            items.insert(self.r.randint(0, len(items)), self.r.choice((self.advert, self.share, self.form, self.sidebar, self.notice))())
        if self.some(0.3):
            half = self.r.randint(0, len(items))
            items = [*items[:half], self.named("main", ("div", "section"), "".join(items[half:]))]
        inside = "".join(items)
        if self.some(0.12):
            inside += self.comments()
        if self.some(0.06):
            inside += f"<footer>{self.text_of('footer')}</footer>"
        kind = self.r.random()
        if kind < 0.42:
            return f"<article>{head}{inside}</article>"
        if kind < 0.5:
            return f"<main>{head}{inside}</main>"
        if kind < 0.58:
            return f"<main><article>{head}{inside}</article></main>"
        if kind < 0.63:
            return head + inside
        if kind < 0.7:
            return head + self.named("main", ("div", "section", "article"), inside)
        return self.named("main", ("div", "div", "section", "article", "main", "td"), head + inside)

    def page(self) -> str:
        often = lambda f, chance: f() if self.some(chance) else ""
        before = [often(self.notice, 0.2), often(self.header, 0.4), often(self.menu, 0.7), often(self.advert, 0.5), often(self.sidebar, 0.15), often(self.notice, 0.15), often(self.form, 0.08), often(self.share, 0.1)]
        after = [often(self.share, 0.2), often(self.advert, 0.25), often(self.comments, 0.35), often(self.sidebar, 0.35), often(self.form, 0.15), often(self.menu, 0.1), often(self.notice, 0.15)]
        self.r.shuffle(before)
        self.r.shuffle(after)
        middle = self.article()
        for _ in range(self.r.choice((0, 0, 1, 2))):
            middle = f'<div class="{self.r.choice(NAMES["wrap"].split())}">{often(self.sidebar, 0.1)}{middle}{often(self.sidebar, 0.1)}</div>'
        body = "".join(before) + middle + "".join(after) + often(self.footer, 0.85) + often(self.notice, 0.1)
        head = f"<head><meta charset=utf-8><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + self.r.choice(("</body></html>", "</body></html>", ""))


def compose(n: int, seed: int = 0) -> list[str]:
    """``n`` labelled pages, each of its own layout."""
    return [Composer(seed * 1_000_003 + i).page() for i in range(n)]
