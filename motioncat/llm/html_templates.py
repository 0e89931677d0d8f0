"""Labelled training pages: layouts of many kinds, written around sentences of real pages.

Text of the article carries no mark; a page is returned with the set of its other texts' ids:
every text ends with a number in brackets that is unique in the page, which the trainer reads
back from the parsed blocks and removes.
"""

from __future__ import annotations

import random

# ---- fixed values: names that sites give to parts of a page ----
ROLES = {
    "menu": ["nav", "menu", "navbar", "navigation", "main-nav", "topnav", "menu-items", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "pager"],
    "header": ["header", "site-header", "masthead", "topbar", "banner", "page-header", "branding", "logo", "hero-nav", "top"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "footer-links", "legal", "page-footer", "imprint"],
    "sidebar": ["sidebar", "side", "widget", "widgets", "aside", "rail", "related", "related-posts", "recommended", "trending", "popular", "more-stories", "secondary", "recent-posts", "tag-cloud"],
    "notice": ["cookie", "cookie-banner", "consent", "gdpr", "notice", "alert", "message", "popup", "modal", "subscribe-notice", "paywall", "overlay", "toast", "warning-bar"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad", "ad-slot", "adsense", "dfp", "sponsor", "partner-content", "outbrain", "taboola"],
    "form": ["search", "newsletter", "signup", "subscribe", "login", "contact-form", "search-form", "register", "feedback"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "discussion", "disqus", "respond", "reader-comments", "responses", "user-comments"],
    "share": ["share", "social", "sharing", "social-links", "share-buttons", "addthis", "follow", "print-links"],
    "article": ["article", "content", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "body-text", "main-content", "text", "article-text", "page-content", "blog-post", "story-body"],
    "wrapper": ["wrap", "container", "page", "wrapper", "row", "col", "inner", "layout", "site", "grid", "section", "outer", "app"],
}
TAGS = {
    "menu": ["nav", "nav", "ul", "div", "menu"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "div", "aside", "section", "dialog"], "advert": ["div", "div", "aside", "section", "ins"], "form": ["form", "form", "div"],
    "comments": ["section", "div", "div", "ol", "aside"], "share": ["div", "ul", "p"], "article": ["article", "article", "main", "div", "div", "section"], "wrapper": ["div", "div", "main", "section"],
}
COMMENT_HEADS = ["Comments", "Kommentare", "Commentaires", "Comentarios", "Discussion", "Leave a reply", "Join the conversation"]
SHORT = ["Home", "About", "Contact", "Login", "More", "Next", "Previous", "Share", "Tweet", "Reply", "Read more", "Subscribe", "Accept", "Search", "Print", "Email", "Top"]


class Page:
    def __init__(self, rng: random.Random, sentences: list[str]) -> None:
        self.rng, self.sentences = rng, sentences
        self.other: set[int] = set()
        self.count = 0
        self.plain = rng.random() < 0.15  # a site that names nothing
        self.semantic = rng.random() < 0.6

    def say(self, text: str, main: bool) -> str:
        self.count += 1
        if not main:
            self.other.add(self.count)
        return f"{text} [[{self.count}]]"

    def some(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(low, high)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.sentences).split()[: self.rng.randint(low, high)])

    def open(self, role: str, tag: str | None = None) -> tuple[str, str]:
        rng = self.rng
        tag = tag or (rng.choice(TAGS[role]) if self.semantic else "form" if role == "form" and rng.random() < 0.6 else "div")
        name = rng.choice(ROLES[role])
        if rng.random() < 0.3:
            name = rng.choice(["site-", "c-", "js-", "my-", "page-", "block-"]) + name
        if rng.random() < 0.2:
            name += rng.choice(["-wrap", "-1", "Box", "_area", "-inner", " clearfix", " col-8"])
        bare = self.plain or (rng.random() < 0.25 and tag not in ("div", "ins", "p", "ul", "ol")) or (role == "wrapper" and rng.random() < 0.4)
        attrs = "" if bare else f' {rng.choice(["class", "class", "class", "id"])}="{name}"'
        return f"<{tag}{attrs}>", f"</{tag}>"

    def links(self, low: int, high: int) -> str:
        rng = self.rng
        items = [f'<a href="/x">{self.say(self.words(1, 3) if rng.random() < 0.6 else rng.choice(SHORT), False)}</a>' for _ in range(rng.randint(low, high))]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return rng.choice([" | ", " ", " · ", "<br>"]).join(items)

    def paragraph(self, main: bool, low: int = 1, high: int = 6) -> str:
        text = self.say(self.some(low, high), main)
        words = text.split(" ")
        if self.rng.random() < 0.3 and len(words) > 6:
            i = self.rng.randrange(len(words) - 4)
            words[i] = self.rng.choice(["<b>", '<a href="#">', "<em>", "<span>"]) + words[i]
            words[i + 2] += {"<b>": "</b>", "<em>": "</em>", "<span>": "</span>"}.get(words[i].split(">")[0] + ">", "</a>")
        return "<p>" + " ".join(words) + ("</p>" if self.rng.random() < 0.9 else "")

    def part(self, role: str) -> str:
        rng = self.rng
        a, b = self.open(role)
        if role in ("menu", "share"):
            return a + self.links(2, 9) + b
        if role == "header":
            return a + rng.choice(["", f"<h1>{self.say(self.words(1, 3), False)}</h1>", f"<div>{self.say(self.words(1, 4), False)}</div>"]) + (self.links(1, 6) if rng.random() < 0.6 else f"<p>{self.say(self.words(2, 8), False)}</p>") + b
        if role == "footer":
            body = "&copy; " + self.say(self.words(1, 2) + " &middot; " + self.some(1, 2), False)
            return a + rng.choice([body, f"<p>{body}</p>"]) + (self.links(2, 8) if rng.random() < 0.5 else "") + b
        if role == "sidebar":
            out = f"<h3>{self.say(self.words(1, 3), False)}</h3>" if rng.random() < 0.7 else ""
            for _ in range(rng.randint(1, 3)):
                out += self.links(2, 6) if rng.random() < 0.6 else self.paragraph(False, 1, 2)
            return a + out + b
        if role in ("notice", "advert"):
            out = self.say(self.some(1, 3), False) if rng.random() < 0.6 else self.paragraph(False, 1, 3)
            return a + out + (f"<button>{self.say(rng.choice(SHORT), False)}</button>" if rng.random() < 0.4 else "") + b
        if role == "form":
            out = f"<label>{self.say(self.words(1, 3), False)}</label><input name=q>" + (f"<p>{self.say(self.some(1, 1), False)}</p>" if rng.random() < 0.4 else "")
            if rng.random() < 0.3:
                out += "<select>" + "".join(f"<option>{self.say(rng.choice(SHORT), False)}" for _ in range(3)) + "</select><textarea></textarea>"
            return a + out + f"<button>{self.say(rng.choice(SHORT), False)}</button>" + b
        out = f"<h2>{self.say(rng.choice(COMMENT_HEADS), False)}</h2>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 5)):
            tag = "li" if a.startswith("<ol") else rng.choice(["div", "article", "div"])
            c, d = self.open("comments", tag)
            out += c + (f"<b>{self.say(self.words(1, 2), False)}</b>" if rng.random() < 0.5 else f"<div>{self.say(self.words(1, 2), False)}</div>") + self.paragraph(False, 1, 3) + d
        return a + out + b

    def article(self) -> str:
        rng = self.rng
        a, b = self.open("article", "article" if self.semantic and rng.random() < 0.5 else None)
        head = rng.choice(["h1", "h1", "h1", "h2"])
        out = f"<{head}>{self.say(self.words(4, 12), True)}</{head}>" if rng.random() < 0.9 else ""
        if rng.random() < 0.15:
            out = f"<header>{out}</header>"
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            pick = rng.random()
            if pick < 0.1:
                out += f"<p>{self.say(self.words(1, 7), True)}</p>"
            elif pick < 0.72:
                out += self.paragraph(True)
            elif pick < 0.8:
                out += f"<h{rng.choice('23')}>{self.say(self.words(2, 6), True)}</h2>"[:-5] + "</h2>"
            elif pick < 0.86:
                out += "<ul>" + "".join(f"<li>{self.say(self.words(3, 9) if rng.random() < 0.5 else self.some(1, 1), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            elif pick < 0.89:
                out += f"<blockquote>{self.paragraph(True, 1, 2)}</blockquote>"
            elif pick < 0.92:
                out += f"<div>{self.say(self.some(1, 3), True)}</div>"
            elif pick < 0.94:
                out += "<table>" + "".join(f"<tr><td>{self.say(self.words(1, 3), True)}</td><td>{self.say(self.words(1, 4), True)}</td></tr>" for _ in range(2)) + "</table>"
            elif pick < 0.96:
                out += f"<pre>{self.say(self.words(3, 9), True)}</pre>"
            else:
                out += self.part(rng.choice(["advert", "share", "notice", "sidebar", "form"]))
        if rng.random() < 0.2:
            out += self.part(rng.choice(["share", "advert", "form", "sidebar", "comments"]))
        if rng.random() < 0.08:
            return out  # right in the page
        return a + out + b

    def html(self) -> str:
        rng = self.rng
        if rng.random() < 0.06:  # nothing but text
            body = self.article() if rng.random() < 0.7 else self.say(self.some(1, 4), True)
            return rng.choice([body, f"<html><body>{body}</body></html>", f"<div>{body}</div>"])
        top = [self.part(r) for r in ("notice", "header", "menu", "form", "advert") if rng.random() < {"menu": 0.8, "header": 0.6}.get(r, 0.3)]
        rng.shuffle(top)
        low = [self.part(r) for r in ("comments", "sidebar", "advert", "share", "form", "notice", "menu") if rng.random() < {"comments": 0.4, "sidebar": 0.4}.get(r, 0.15)]
        rng.shuffle(low)
        middle = self.article()
        if rng.random() < 0.5:
            side = [self.part("sidebar")] if rng.random() < 0.4 else []
            near = [low.pop()] if low and rng.random() < 0.4 else []
            a, b = self.open("wrapper")
            middle = a + "".join(rng.sample(side + [middle], 1 + len(side)) + near) + b
        body = "".join(top) + middle + "".join(low) + (self.part("footer") if rng.random() < 0.85 else "")
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            a, b = self.open("wrapper")
            body = a + body + b
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}" + rng.choice(["</body></html>", "</body></html>", ""])
