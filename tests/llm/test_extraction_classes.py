"""Words of a class or id don't take the article out of a page."""

import pytest

from quotelens.llm import html_extraction

TEXT = "The first sentence, with words. And one more, longer than that; it ends here."
AROUND = ['class="layout has-sidebar"', 'class="no-sidebar"', 'class="content-with-rail"', 'class="post-share-enabled"', 'id="search-results-page"', 'class="widget-area main-content"']
AD = '<div class="ad">Buy this, now.</div>'
COMMENTS = f'<section id="comments"><article class="comment"><p>{"I liked it, a lot. " * 40}</p></article></section>'


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("inner", ["<article><p>{}</p>" + AD + "</article>", "<main><p>{}</p>" + AD + "</main>", "<p>{}</p>" + AD])
def test_an_element_around_the_article_stays(around, inner):
    article = inner.format(TEXT)
    for page in (f"<body><div {around}>{article}</div></body>", f"<body><main><div {around}>{article}</div></main></body>"):
        assert html_extraction.main_text(page) == TEXT


def test_an_element_with_most_of_the_article_stays():
    assert html_extraction.main_text(f'<body><article><div class="content-with-rail"><p>{TEXT}</p></div>{AD}</article></body>') == TEXT


def test_comments_go_however_long_they_are():
    assert html_extraction.main_text(f"<body><article><p>{TEXT}</p></article>{COMMENTS}</body>") == TEXT
    assert html_extraction.main_text(f"<body><article><p>{TEXT}</p>{COMMENTS}</article></body>") == TEXT
