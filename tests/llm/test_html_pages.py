"""Pages written by hand, of unlike layouts: the whole text that the field finds."""

import pytest

from candela.llm import html

PAGES = [
    pytest.param(
        '<body><div class="cookiebar"><p>We use cookies on this site.</p></div><article><h1>Title of it</h1><p>First long paragraph of the story, with words.</p></article></body>',
        'Title of it\nFirst long paragraph of the story, with words.',
        id='a notice named by a longer word',
    ),
    pytest.param(
        '<body><div><h1>Rain falls over the hills</h1><p>It rained all day over the hills, and the rivers rose.</p><p>People stayed at home and waited for the sun.</p></div><div><h3>Most read</h3><ul><li><a href=1>Sun rises again</a></li><li><a href=2>Wind blows on the coast</a></li></ul></div></body>',
        'Rain falls over the hills\nIt rained all day over the hills, and the rivers rose.\nPeople stayed at home and waited for the sun.',
        id='an unnamed side column',
    ),
    pytest.param(
        '<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td></tr><tr><td><h1>A ship arrives</h1><p>The ship arrived at noon, with goods from far away.</p><p>It will leave on Monday.</p></td></tr><tr><td>Copyright 2020 Example Ltd</td></tr></table>',
        'A ship arrives\nThe ship arrived at noon, with goods from far away.\nIt will leave on Monday.',
        id='a page that is a table',
    ),
    pytest.param(
        '<main><h1>On bread</h1><p>Bread is made of flour, water and salt, and it takes time.</p><p>Bake it well.</p></main><div><h3>3 comments</h3><p>Ann 2 days ago</p><p>Nice bread, thank you!</p><p>Bob 1 day ago</p><p>I tried it and it works.</p></div>',
        'On bread\nBread is made of flour, water and salt, and it takes time.\nBake it well.',
        id='comments that nothing names',
    ),
    pytest.param(
        '<article><h1>Night</h1><p style="display:none">Hidden line one.</p><p>The night was dark, and the wind was cold.</p><div hidden>Hidden line two.</div></article>',
        'Night\nThe night was dark, and the wind was cold.',
        id='hidden parts',
    ),
    pytest.param(
        '<body><table><tr><td><a href="/">Home</a></td><td><a href="/n">News</a></td></tr></table><div id="c"><h1>The old mill</h1><p>The mill stood by the river for two hundred years.</p><blockquote><p>It was our home, she said.</p></blockquote></div><p>&copy; 2021 Valley Press</p></body>',
        'The old mill\nThe mill stood by the river for two hundred years.\nIt was our home, she said.',
        id='rights after an unnamed article',
    ),
    pytest.param(
        '<header><h1>Daily Post</h1></header><nav><ul><li><a href=1>World</a></li></ul></nav><article><h2>Bees return</h2><p>After years of decline, the bees are back.</p><ul><li>More flowers, more bees.</li><li>Fewer sprays.</li></ul></article><aside class="sidebarRight"><h3>Latest</h3><p>Other words here.</p></aside><footer>All rights reserved.</footer>',
        'Bees return\nAfter years of decline, the bees are back.\nMore flowers, more bees.\nFewer sprays.',
        id='a header, a menu, an aside, a footer',
    ),
    pytest.param(
        '<div class="page"><div class="commentSection"><p>I like it.</p></div><div class="articleText"><h1>Stars</h1><p>The stars were out, and the night was still.</p></div></div>',
        'Stars\nThe stars were out, and the night was still.',
        id='compound names',
    ),
    pytest.param(
        '<div class="site-header"><a href=/>Site</a></div><main><h1>Tea</h1><p>Tea is best when hot, they say.</p><div class="advertBox"><p>Buy tea now!</p></div><p>Drink it slowly.</p></main>',
        'Tea\nTea is best when hot, they say.\nDrink it slowly.',
        id='an advert amid the article',
    ),
    pytest.param(
        '<article><h1>Fog</h1><p>Fog covered the town, and all was quiet.</p></article><section><h2>Comments (2)</h2><div><p>Lee 5 hours ago</p><p>So true.</p></div></section>',
        'Fog\nFog covered the town, and all was quiet.',
        id='a section of comments',
    ),
    pytest.param(
        '<article><h1>Salt</h1><p aria-hidden="true" style="visibility: hidden">no</p><p class="hidden-gem">A gem of a place, by the salt lake.</p></article>',
        'Salt\nA gem of a place, by the salt lake.',
        id='a hidden paragraph and a name that holds the word',
    ),
    pytest.param(
        '<form><label>Name</label><input name=a><button>Send</button></form><article><p>One line only, but long enough to count as text.</p></article>',
        'One line only, but long enough to count as text.',
        id='a form before',
    ),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_page(page, text):
    assert html.trained().main_text(page) == text


def test_equal_rows_and_clashing_columns(spark):
    page = PAGES[0].values[0]
    rows = [(1, "u", page, 7, "t"), (1, "u", page, 7, "t"), (None, None, None, 7, "t"), (2, "v", "", 7, "t")]
    out = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string"), html.trained()).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in out) == sorted([("1", "u", PAGES[0].values[1], len(PAGES[0].values[1]))] * 2 + [("None", "None", "", 0), ("2", "v", "", 0)])


def test_hidden_is_told_from_names_and_values():
    assert html._hidden(' hidden') and html._hidden(' class="a" hidden="" ') and html._hidden(" style='color:red; DISPLAY : none'") and html._hidden(' style="visibility:hidden"')
    assert not html._hidden(' class="hidden"') and not html._hidden(' data-hidden="1"') and not html._hidden(' style="display:block" title="none"') and not html._hidden(' aria-hidden="false"')
