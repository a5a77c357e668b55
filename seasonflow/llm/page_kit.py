"""Labelled pages to train and test the page extractor: drawn layouts of which the main text is known.

A page is a sequence of parts (menus, headers, notices, adverts, the article, sidebars, forms, reader comments, footers) in
drawn order and nesting. Each part is a semantic element or a div or section named by a drawn word, or both; its texts
are invented words, so that a text tells by its form, not by its vocabulary. Articles hold headings, paragraphs (also
unclosed), lists, quotations, tables and captions, and have foreign parts within them. The same seed draws the same page.
"""

from __future__ import annotations

import html
import random

#: Names that pages give to parts which are not main text.
NAMES = {
    "nav": "nav navigation navbar menu main-menu site-nav topnav breadcrumb breadcrumbs pagination pager tabs links sitemap toc-nav nav-links language-switch skip-links",
    "header": "header site-header page-header masthead topbar top branding logo banner head site-title",
    "footer": "footer site-footer page-footer foot bottom colophon copyright legal imprint credits",
    "aside": "sidebar side aside rail right-rail widget widgets related related-posts recommended popular trending more-stories teaser teasers see-also read-more latest author-box bio tags",
    "notice": "notice notices cookie cookie-banner cookie-notice consent gdpr privacy-notice alert alert-box message popup modal overlay announcement disclaimer warning info-bar toast paywall",
    "ad": "ad ads advert advertisement adbox ad-slot ad-container sponsor sponsored sponsored-content promo promotion promoted commercial banner-ad google-ads affiliate",
    "form": "form search search-form search-box newsletter newsletter-signup subscribe subscription signup sign-up login contact-form poll survey feedback-form",
    "comments": "comments comment comment-list commentlist comments-area respond reply replies discussion disqus reader-comments responses user-comments thread reviews opinions feedback guestbook",
    "share": "share sharing social social-links share-buttons toolbar tools actions",
}
MAIN = "article content main post entry story text body article-body post-content entry-content main-content page-content story-body article-text post-body prose copy primary"
PLAIN = "wrapper wrap container inner outer row col grid page layout site box block section-1 c12 x7 css-1a2b clearfix flex region"
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "search", "notice": "alert"}
SYLLABLES = "an ar be con da de el en er es for ga ge hi in is ka la le li ma men mo na ne no on or pa per qui ra re ri ro sa se si sta su ta te ti to tra un va ver vi zu é ä ñ ü ç ó".split()
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "é": "&eacute;", "ä": "&#228;", "ñ": "&#xf1;"}


class Page:
    """Draws one page; lines collects the main text's blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lines: list[str] = []
        self.bare = self.r.random() < 0.4  # semantic elements without names
        self.divs = self.r.random() < 0.3  # no semantic elements
        self.vocabulary = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(120)]
        self.marks = self.r.choice(["", "", "", "&", "%", "$#"])

    def some(self, share: float) -> bool:
        return self.r.random() < share

    def words(self, low: int, high: int) -> str:
        found = self.r.choices(self.vocabulary, k=self.r.randint(low, high))
        return " ".join(w + (self.r.choice(self.marks) * 3 if self.marks and self.some(0.5) else "") for w in found)

    def sentence(self, low: int = 3, high: int = 18) -> str:
        w = self.words(low, high).split(" ")
        return (" ".join(x + "," if self.some(0.08) else x for x in w).rstrip(",") + self.r.choice("....?!")).capitalize()

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def shown(self, text: str, inline: bool = True) -> str:
        """HTML of a text: references, odd white space, inline elements."""
        words = [html.escape(w, quote=False) for w in text.split(" ")]
        if self.some(0.2):
            words = ["".join(ENTITIES.get(c, c) for c in html.unescape(w)) for w in words]
        if inline and len(words) > 3 and self.some(0.4):
            i = self.r.randrange(len(words) - 1)
            tag = self.r.choice(["b", "i", "em", "strong", "a", "span", "code"])
            words[i] = f"<{tag}{' href=/x' if tag == 'a' else ''}>{words[i]}"
            words[min(len(words) - 1, i + self.r.randint(0, 3))] += f"</{tag}>"
        return self.r.choice([" ", " ", " ", "\n  "]).join(words)

    def name(self, kind: str, sure: bool) -> str:
        """Attributes: a drawn name as class or id, a role."""
        out = ""
        if sure or self.some(0.5):
            word = self.r.choice(NAMES[kind].split() if kind in NAMES else kind.split())
            if self.some(0.3):
                word = self.r.choice(["site", "page", "js", "m", "block", "article"]) + self.r.choice("-_") + word
            out += f' {self.r.choice(["class", "class", "id"])}="{word}{" " + self.r.choice(PLAIN.split()) if self.some(0.2) else ""}"'
        if kind in ROLES and self.some(0.15):
            out += f' role="{ROLES[kind]}"'
        return out

    def around(self, kind: str, inner: str) -> str:
        tag = TAGS.get(kind)
        if kind == "form" and "<input" in inner:
            inner = f"<form>{inner}</form>" if self.some(0.8) else inner
        if tag is None or self.divs or self.some(0.35):
            tag = self.r.choice(["div", "div", "section", "aside" if kind in ("ad", "notice", "share") and not self.divs else "div"])
            return f"<{tag}{self.name(kind, True)}>{inner}</{tag}>"
        return f"<{tag}{'' if self.bare else self.name(kind, False)}>{inner}</{tag}>"

    def items(self, low: int, high: int, linked: bool = True) -> str:
        one = [f"<a href=/{k}>{self.shown(self.words(1, 4), False)}</a>" if linked else self.shown(self.words(1, 6)) for k in range(self.r.randint(low, high))]
        if self.some(0.75):
            return "<ul>" + "".join(f"<li>{x}{'</li>' if self.some(0.9) else ''}" for x in one) + "</ul>"
        return self.r.choice([" ", " | ", " · "]).join(one)

    def foreign(self, kind: str) -> str:
        """A part that isn't main text."""
        prose = lambda low, high: self.r.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "{}"]).format(self.shown(self.prose(low, high)))
        if kind == "nav":
            inner = self.items(2, 12)
        elif kind == "header":
            inner = self.r.choice(["<h1>{}</h1>", "<a href=/>{}</a>", "<div>{}</div>", "<h2>{}</h2>"]).format(self.shown(self.words(1, 4), False))
            inner += f"<p>{self.shown(self.sentence())}</p>" if self.some(0.4) else ""
            inner += self.foreign("nav") if self.some(0.4) else ""
        elif kind == "footer":
            inner = self.r.choice(["&copy; {} &middot; {}", "<p>&copy; {}</p><p>{}</p>", "{} {}", "<p>{}</p>{}"]).format(self.words(1, 3), self.shown(self.prose(1, 3)))
            inner += self.items(2, 6) if self.some(0.4) else ""
        elif kind == "aside":
            inner = (f"<h3>{self.shown(self.words(1, 5), False)}</h3>" if self.some(0.6) else "") + (self.items(2, 8) if self.some(0.5) else prose(1, 4))
            inner += "".join(f"<h4><a href=/>{self.words(2, 6)}</a></h4>{prose(1, 2)}" for _ in range(self.r.randint(0, 3)))
        elif kind == "notice":
            inner = prose(1, 4) + (f"<button>{self.words(1, 2)}</button>" if self.some(0.5) else "")
        elif kind == "ad":
            inner = self.r.choice([prose(1, 3), self.shown(self.prose(1, 2)), f"<a href=/ad>{self.shown(self.sentence(), False)}</a>", f"<h3>{self.words(2, 5)}</h3>{prose(1, 2)}"])
        elif kind == "form":
            inner = f"<label>{self.shown(self.words(1, 5), False)}</label><input name=q>" + (prose(1, 2) if self.some(0.5) else "")
            inner += f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>" if self.some(0.3) else ""
            inner += f"<textarea>{self.words(1, 3)}</textarea>" if self.some(0.2) else ""
            inner += f"<button>{self.words(1, 2)}</button>"
        elif kind == "share":
            inner = self.items(2, 5)
        else:
            each = self.r.choice(["<div class=comment>{}</div>", "<li>{}</li>", "<article>{}</article>", "<div>{}</div>", "{}"])
            inner = f"<h{self.r.randint(2, 4)}>{self.words(1, 4)}</h2>" if self.some(0.6) else ""
            for _ in range(self.r.randint(1, 6)):
                by = self.r.choice(["<b>{}</b> ", "<div class=author>{}</div>", "<p>{}</p>", "<h4>{}</h4>", ""]).format(self.words(1, 3))
                inner += each.format(by + prose(1, 4) + (f"<a href=/r>{self.words(1, 1)}</a>" if self.some(0.4) else ""))
            inner += self.foreign("form") if self.some(0.3) else ""
        return self.around(kind, inner)

    def line(self, text: str, form: str, inline: bool = True) -> str:
        self.lines.append(text)
        return form.format(self.shown(text, inline))

    def article(self, title: str) -> str:
        out = []
        if self.some(0.9):
            out.append(self.line(title, self.r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>" if not self.divs else "<h1>{}</h1>"])))
        unclosed = self.some(0.25)
        for _ in range(self.r.choice([1, 2, 4, 7, 12])):
            draw = self.r.random()
            size = self.r.choice([(1, 1), (1, 3), (3, 8)])
            if draw < 0.72:
                text = self.words(1, 2).capitalize() + "." if self.some(0.12) else self.prose(*size)
                form = self.r.choice(["<p>{}", "<p><b>{}<br>", "<p>{}<p>"]) if unclosed and self.some(0.5) else self.r.choice(["<p>{}</p>"] * 7 + ["<div>{}</div>"])
                out.append(self.line(text, form))
            elif draw < 0.8:
                out.append(self.line(self.words(1, 7).capitalize(), self.r.choice(["<h2>{}</h2>", "<h3>{}</h3>"])))
            elif draw < 0.86:
                many = [self.line(self.r.choice([self.words(1, 6), self.sentence()]), "<li>{}</li>") for _ in range(self.r.randint(1, 5))]
                out.append(self.r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(many)))
            elif draw < 0.89:
                out.append(self.line(self.prose(1, 3), self.r.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"])))
            elif draw < 0.91:
                cells = [[self.line(self.words(1, 3), self.r.choice(["<td>{}</td>", "<td>{}"])) for _ in range(2)] for _ in range(self.r.randint(1, 3))]
                out.append("<table>" + "".join(f"<tr>{''.join(row)}</tr>" for row in cells) + "</table>")
            elif draw < 0.93:
                out.append(self.line(self.sentence(), "<figure><img src=a.png><figcaption>{}</figcaption></figure>"))
            else:
                out.append(self.foreign(self.r.choice(["ad", "ad", "share", "aside", "aside", "aside", "notice", "form", "nav"])))
        if self.some(0.1):
            out.append(self.foreign("comments"))
        return "".join(out)

    def main(self, title: str) -> str:
        inner = self.article(title)
        draw = self.r.random()
        if self.divs:
            forms = [f'<div {self.r.choice(["class", "id"])}="{self.r.choice(MAIN.split())}">{{}}</div>'] * 4 + ["<div>{}</div>", "{}", '<div class="c12 x7">{}</div>']
        else:
            named = self.r.choice(MAIN.split())
            forms = ["<article>{}</article>"] * 5 + ["<main>{}</main>"] * 2 + [
                f'<article class="{named}">{{}}</article>', f'<main id="{named}"><article>{{}}</article></main>', f'<div class="{named}">{{}}</div>',
                f'<section class="{named}">{{}}</section>', "<section>{}</section>", "{}", f'<article><div class="{named}">{{}}</div></article>'
            ]
        out = self.r.choice(forms).format(inner.replace("{", "&#123;").replace("}", "&#125;"))
        if draw < 0.15:
            tag = "main" if not self.divs else self.r.choice(["div id=content", "div id=main"])
            before = "".join(self.foreign(k) for k in self.r.sample(["nav", "ad", "notice", "share"], self.r.randint(0, 2)))
            after = "".join(self.foreign(k) for k in self.r.sample(["comments", "aside", "form", "ad", "share"], self.r.randint(0, 3)))
            out = f"<{tag}>{before}{out}{after}</{tag.split()[0]}>"
        return out

    def page(self) -> tuple[str, str]:
        """(HTML, main text)."""
        title = self.sentence(2, 10)[: self.r.choice([60, 200])].strip()
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if self.some({"nav": 0.8, "header": 0.5, "ad": 0.5}.get(k, 0.25))]
        after = [k for k in ("share", "aside", "comments", "ad", "form", "nav", "notice") if self.some({"comments": 0.4, "aside": 0.4}.get(k, 0.2))]
        self.r.shuffle(before)
        self.r.shuffle(after)
        parts = [self.foreign(k) for k in before] + [self.main(title)] + [self.foreign(k) for k in after]
        parts += [self.foreign("footer")] if self.some(0.85) else []
        if self.some(0.3):
            i, k = sorted(self.r.sample(range(len(parts) + 1), 2))
            name = self.r.choice(PLAIN.split() + ["page with-sidebar", "content-wrapper has-sidebar", "layout-sidebar-right"])
            parts[i:k] = [f'<div class="{name}">' + "".join(parts[i:k]) + "</div>"]
        between = self.r.choice(["", "", "\n", "<!-- part --><script>var t='</p><p>no</p>';</script>"])
        body = between.join(parts)
        head = f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title><style>p{{margin:0}}</style></head>" if self.some(0.9) else ""
        end = "</body></html>" if self.some(0.85) else ""
        return f"{head}<body{self.r.choice(['', '', ' class=\"has-sidebar single-post\"'])}>{body}{end}", "\n".join(self.lines)


def labelled_pages(n: int, first: int = 0) -> list[tuple[str, str]]:
    """n pairs (HTML, main text), those of the seeds from `first` on."""
    return [Page(seed).page() for seed in range(first, first + n)]
