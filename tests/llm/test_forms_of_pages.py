"""Parts of pages that are not the article: forms, menus, dialogs, searches, and names that hold a mark beside other words."""

import pytest

from lectern.llm import html

ARTICLE = "<h1>Title</h1><p>The ship went along the shore until the evening came.</p><p>Then it lay still.</p>"
TEXT = "Title\n\nThe ship went along the shore until the evening came.\n\nThen it lay still."


@pytest.mark.parametrize("page", [
    f'<body><form id="aspnetForm" action="x"><div class="page"><nav>Home</nav><article>{ARTICLE}</article></div></form></body>',
    f'<body><form action="x"><div>{ARTICLE}</div><form><label>Name</label></form></form></body>',
    f"<body><form><p>{'A long paragraph of the page. ' * 20}</p></form></body>",
    f'<body><div>{ARTICLE}</div><form class="search"><p>Search here</p><input></form></body>',
    f"<body><div>{ARTICLE}<form><p>Your name</p><label>Mail</label></form></div></body>",
    f"<body><menu><li>Home</li><li>About</li></menu>{ARTICLE}</body>",
    f"<body>{ARTICLE}<dialog open><p>We use cookies.</p></dialog></body>",
    f"<body><search><p>Find a page</p></search>{ARTICLE}</body>",
    f'<body>{ARTICLE}<div class="notice-table"><table><tr><td>Closed today</td></tr></table></div></body>',
    f'<body>{ARTICLE}<section role="dialog"><p>Sign up</p></section><div class="comment-body"><p>Nice.</p></div></body>',
    f'<body><div class="search-form"><p>Find</p></div><main>{ARTICLE}</main></body>',
])
def test_left_out_and_kept(page):
    got = html.extract(page, None)
    assert got == (TEXT if "Title" in page else ("A long paragraph of the page. " * 20).strip())


def test_pages_of_one_host_in_a_form(spark):
    """The template's slot lies inside the form that wraps each page."""
    pages = [(k, "https://h.example/a", f'<html><body><form id="f"><nav>Home</nav><div class="top">Same on all</div><div class="text"><h1>Title {k}</h1><p>Text of page {k}.</p></div><footer>End</footer></form></body></html>') for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"Title {k}\n\nText of page {k}." for k in range(6)}
