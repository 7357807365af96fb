"""Labelled pages for the HTML extraction: made-up layouts, each with its article's text marked.

A layout is the path of elements around the article, then the elements before, among and after
its paragraphs that are not the article, as selectors (``div.ad.wide#x``). All names are common
ones of publishing systems, or of their themes' state (``has-sidebar``, ``comments-open``).
"""

from __future__ import annotations

import random

LAYOUTS = [
    ("body.home.has-sidebar div#page.site div#content.site-content article.post.hentry div.entry-content",
     "header.site-header nav.main-navigation.menu div.cookie-notice", "div.ad div.share-buttons", "footer.entry-footer section#comments.comments-area aside.sidebar.widget-area footer.site-footer"),
    ("body.single.no-sidebar.comments-open main#main.site-main article.type-post.format-standard div.post-content",
     "div.top-bar div#masthead.header ul.breadcrumbs", "aside.related-posts", "div.author-box div#respond.comment-respond ol.comment-list footer#colophon"),
    ("body.page-template.with-sidebar div.container div.row div.col-md-8.main-content", "div.navbar div.banner", "div.adsbygoogle", "div.col-md-4.sidebar-right div.newsletter-signup div.footer"),
    ("body.layout-wide.sidebar-enabled div.wrapper section.story div.story-body", "nav#nav div.masthead div.alert", "figure.promo div.ad-slot", "div.recommended div#disqus_thread.disqus div.copyright"),
    ("html body div.body div.text", "div#menu.menu div.search-form form.search", "div.advertisement", "div.pagination div.disclaimer div#footer"),
    ("body table.layout td.content-cell", "td.nav td.left-menu", "div.advert", "td.right-column.sidebar div.footer-links"),
    ("body div#main.comments-closed div.blog-post", "header nav.breadcrumb div.notice", "div.social div.tweet", "div.comments section.related footer"),
    ("body.has-cookie-banner div.news-item div.article-body", "div.gdpr.consent dialog.modal div.paywall", "aside.pullout div.sponsored", "div.subscribe div.replies div.site-info"),
    ("body div.forum-page div.question div.post-text", "div.toolbar div.user-menu div.login", "div.promoted", "div.discussion form.reply-form div.page-footer"),
    ("body.docs div.documentation div.markdown-body", "nav.toc-nav div.page-header menu.tools", "div.callout-ad", "div.pager div.feedback-form footer.docs-footer"),
    ("body article.entry.is-open div.rich-text", "div.popup div.overlay-newsletter", "div.widget div.sharing", "div.widgets div.responses section.reader-comments div.bottom-footer"),
    ("body div.product div#description.description", "div.mini-cart fieldset.options button.buy", "div.banner-ad", "div.related-products div.reviews.user-comments div.legal-notice"),
    ("body.magazine main div.longread section.chapter", "header.main-header nav.top-nav div.skip-link", "aside.sidebar-note div.adbox", "div.more-stories div.most-read div.social-links footer.main-footer"),
    ("body.wiki div#mw-content div.parser-output", "div.site-notice div#mw-navigation.navigation", "table.navbox div.ads", "div.catlinks div.footer-nav div.sidebar-left"),
    ("body div.recipe-page div.recipe section.steps", "div.topbar nav.navigation-menu div.cookies", "div.ad-unit div.video-ad", "div.comment-form div.signup div.sponsor aside"),
    ("body div.widget-page.with-ads div.guide-text", "header.top-header div.breadcrumb-trail", "div.adverts div.ad-container", "div.share div.related footer.bottom"),
    ("body.no-ads.has-menu div.press-release div.body-copy", "nav.side-nav div.announcement", "div.sponsor-box", "div.sidebar div.comments-section div.widget-sidebar"),
    ("body.single-post.has-comments div.story-wrap div.story-text", "menu.menubar div.header-menu div.alert-box", "form.newsletter div.ad-banner", "div#sidebar div#comments div.footer-widgets form.comment-form"),
]

ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
#: Starts each run of words that is the article's.
MARK = "\ue000"


def _open(selector: str) -> tuple[str, str]:
    name, marks = "", {"class": [], "id": []}
    part, kind = "", "name"
    for c in selector + ".":
        if c in ".#":
            if kind == "name":
                name = part
            elif part:
                marks[kind].append(part)
            part, kind = "", "class" if c == "." else "id"
        else:
            part += c
    given = "".join(f' {k}="{" ".join(v)}"' for k, v in marks.items() if v)
    return f"<{name}{given}>", f"</{name}>"


def labelled_pages() -> list[str]:
    """Pages of all layouts; runs of words that are the article's start with MARK."""
    rng, pages = random.Random(7), []
    words = lambda a, b: " ".join("".join(rng.choices("aeinorst", k=rng.randrange(2, 9))) for _ in range(rng.randrange(a, b)))
    links = lambda: "<ul>" + "".join(f"<li><a href='/{k}'>{words(1, 3)}</a></li>" for k in range(rng.randrange(4, 9))) + "</ul>"

    def side(selector: str, role: str = "") -> str:
        start, end = _open(selector)
        if role:
            start = f'{start[:-1]} role="{role}">'
        return start + (links() if rng.random() < 0.5 else f"<p>{words(5, 25)}</p>") + end

    for k, (path, before, among, after) in enumerate(LAYOUTS * 2):
        tags = [_open(s) for s in path.split()]
        prose = [f"<p>{MARK}{words(12, 60)} <a href='/{k}'>{MARK}{words(1, 4)}</a> {MARK}{words(3, 30)}.<br>{MARK}{words(9, 20)} <b>{MARK}{words(1, 4)}</b> <em>{MARK}{words(1, 4)}</em></p>" for _ in range(4)]
        prose[1:1] = [f"<h2>{MARK}{words(2, 6)}</h2>", "<ul>" + "".join(f"<li>{MARK}{words(6, 20)}</li>" for _ in range(3)) + "</ul>"]
        body, extra = "", among.split()
        for i, part in enumerate(prose):
            body += part + (side(extra[i // 2]) if i % 2 and i // 2 < len(extra) else "")
        first = tags[0][0] if "html" in tags[0][0] or "body" in tags[0][0] else "<body>"
        inner = "".join(t for t, _ in tags[1:])
        role = ROLES[k % len(ROLES)]
        pages.append(
            f"<html><head><title>{words(2, 5)}</title></head>{first}{''.join(map(side, before.split()))}{side('div', role)}{inner}<h1>{MARK}{words(3, 8)}</h1>{body}"
            f"{''.join(t for _, t in reversed(tags[1:]))}{''.join(map(side, after.split()))}</body></html>"
        )
    return pages
