"""Main text: what markup may not take away, deep pages, and a plain second scorer over random pages."""

import random
import time

import pytest

from worthrank.llm.html_text import main_text

LONG = "<p>" + "Long words, and more of them, that say something. " * 6 + "</p>"


@pytest.mark.parametrize("names", ["page has-sidebar", "content with-sidebar", "layout-no-sidebar", "header-fixed wrap", "related-work", "entry-content tags-x",
                                   "container ad-free", "share-prices story", "comment-piece", "sidebar", "comments", "site-header", "widget-area"])
def test_a_wrapper_of_the_page_is_not_left_out(names):
    assert main_text(f'<body><div class="{names}">{LONG * 3}</div></body>').count("Long words") == 18
    assert main_text(f'<div id="{names.split()[0]}"><form id="aspnetForm"><header>{LONG * 3}</header></form></div>').count("Long words") == 18


@pytest.mark.parametrize("names", ["sidebar", "site-sidebar", "sidebar-left", "ad", "ad-slot", "share-buttons", "related-posts", "cookie-banner", "comment-list", "pageFooter",
                                   "newsletter-signup", "nav", "main-menu", "breadcrumbs"])
def test_marked_parts_beside_the_article_go(names):
    for part in (f'<div class="{names}"><p>Buy, this, and that.</p></div>', f'<section id="{names}">Other, things</section>'):
        for page in (f"<article>{LONG * 3}{part}</article>", f"<article>{LONG * 3}</article>{part}", f"<div>{part}<div>{LONG * 3}</div></div>"):
            found = main_text(page)
            assert found.count("Long words") == 18 and "Buy" not in found and "Other" not in found


def test_parts_of_an_article_stay():
    assert "Rates rose" in main_text(f'<article>{LONG * 2}<div class="share-price"><p>Rates rose, then fell.</p></div></article>')
    assert main_text(f"<article><header><h1>Headline</h1></header>{LONG}</article>").startswith("Headline\nLong words")
    assert "Site" not in main_text(f"<header><h1>Site, name</h1></header><article>{LONG}</article>")
    assert "Mail" not in main_text(f"<article>{LONG}<form><p>Mail, us, here</p><input></form></article>")


def test_comments_go_even_if_they_are_longer_than_the_article():
    found = main_text(f'<div><div>{LONG}</div><div class="comments">{"<p>I, too, think that, and so on, and on.</p>" * 30}</div></div>')
    assert found.count("Long words") == 6 and "I, too" not in found


@pytest.mark.parametrize("page", ["<div>a" * 100_000, "<b>" * 50_000 + "<div>a</i></u>" * 50_000, "<ul><li>" * 50_000, "<p>a</section>" * 50_000, "<div><p>a<hr>" * 50_000])
def test_deep_pages_take_time_in_proportion(page):
    began = time.time()
    assert main_text(page) is not None
    assert time.time() - began < 5


def test_deep_text_is_whole():
    assert main_text("<div>a " * 3000).split() == ["a"] * 3000


class Part:
    """A random element: a container of parts, or a paragraph with a text of which a part is linked."""

    def __init__(self, rng, depth):
        self.kids = [Part(rng, depth - 1) for _ in range(rng.randint(1, 4))] if depth and rng.random() < 0.8 else []
        words = " ".join(rng.choice(("word", "other,", "third", "a,")) for _ in range(rng.randint(1, 60)))
        self.plain, self.link = (words, rng.choice(("", "", "here", "a link of some words"))) if not self.kids else ("", "")

    def html(self):
        if self.kids:
            return "<div>" + "".join(k.html() for k in self.kids) + "</div>"
        return f"<p>{self.plain}" + (f" <a href=x>{self.link}</a>" if self.link else "") + "</p>"

    def texts(self):
        return [t for k in self.kids for t in k.texts()] if self.kids else [f"{self.plain} {self.link}".strip()]

    def sizes(self):
        """Characters, and those in links."""
        if self.kids:
            return tuple(map(sum, zip(*(k.sizes() for k in self.kids), strict=True)))
        return len(self.texts()[0]), len(self.link)

    def gains(self):
        """(level, points) of each paragraph below, by the level of the container that is this one."""
        if not self.kids:
            text = self.texts()[0]
            return [(-1, (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - len(self.link) / len(text)))]
        return [(level + 1, points) for k in self.kids for level, points in k.gains()]

    def score(self, bonus=0.0):
        chars, linked = self.sizes()
        points = sum(p * (1 if level <= 0 else 0.5 if level == 1 else 1 / (3 * level)) for level, p in self.gains())
        return (points + bonus * (points > 0)) * (1 - linked / chars)


def containers(part):
    return [part] * bool(part.kids) + [c for k in part.kids for c in containers(k)]


@pytest.mark.parametrize("seed", range(60))
def test_articles_and_good_siblings_as_a_plain_scorer_finds_them(seed):
    rng = random.Random(seed)
    article, others = Part(rng, 3), [Part(rng, rng.randint(1, 2)) for _ in range(rng.randint(1, 4))]
    while not article.kids:
        article = Part(rng, 3)
    others = [o for o in others if o.kids]
    at = rng.randint(0, len(others))
    page = "".join(o.html() for o in others[:at]) + "<article>" + "".join(k.html() for k in article.kids) + "</article>" + "".join(o.html() for o in others[at:])
    inside = [article.score(25.0)] + [c.score() for k in article.kids for c in containers(k)]
    beside = [c.score() for o in others for c in containers(o)]
    body = Part(rng, 0)
    body.kids = [*others[:at], article, *others[at:]]
    most = max([*inside, *beside, body.score()])
    if max(inside) < most:  # the best container is not in the article: another rule
        return
    kept = [p for p in body.kids if p is article or p.score() >= max(10.0, 0.2 * most)]
    assert main_text(page).split("\n") == [t for p in kept for t in p.texts()]
