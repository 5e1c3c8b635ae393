import random

import pytest

from corpuslode.operators.sentences import spans, split

#: Sentences as they should come apart; a text is its parts joined by a blank.
GOLDEN = [
    ["Hello World.", "My name is Jonas."],
    ["What is your name?", "My name is Jonas."],
    ["There it is!", "I found it."],
    ["My name is Jonas E. Smith."],
    ["Please turn to p. 55."],
    ["Were Jane and co. at the party?"],
    ["They closed the deal with Pitt, Briggs & Co. at noon."],
    ["Let's ask Jane and co.", "They should know."],
    ["They closed the deal with Pitt, Briggs & Co.", "It closed yesterday."],
    ["I can see Mt. Fuji from here."],
    ["St. Michael's Church is on 5th st. near the light."],
    ["That is JFK Jr.'s book."],
    ["I visited the U.S.A. last year."],
    ["I live in the E.U.", "How about you?"],
    ["I live in the U.S.", "How about you?"],
    ["I work for the U.S. government in Virginia."],
    ["She has $100.00 in her bag."],
    ["She has $100.00.", "It is in her bag."],
    ["He teaches science (He previously worked for 5 years as an engineer.) at the local University."],
    ["Her email is Jane.Doe@example.com.", "I sent her an email."],
    ["The site is: https://www.example.50.com/new-site/awesome_content.html.", "Please check it out."],
    ["She turned to him, \"This is great.\" she said."],
    ["\"Really?\" he asked.", "Nobody answered."],
    ["Hello!!", "Long time no see."],
    ["Hello??", "Who is there?"],
    ["Hello!?", "Is that you?"],
    ["1. The first item.", "2. The second item."],
    ["You can find it at N°. 1026.253.553.", "That is where the treasure is."],
    ["She works at Yahoo! in the accounting department."],
    ["We make a good team, you and I.", "Did you see Albert I. Jones yesterday?"],
    ["Thoreau argues that by simplifying one's life, “the laws of the universe will appear less complex. . . .”"],
    ["One further habit was the interruption of his conversation with ... pauses."],
    ["I never meant that....", "She left the store."],
    ["I wasn't really ... well, what I mean...see . . . what I'm saying, the thing is . . . I didn't mean it."],
    ["Dr. Brown met Prof. Green and Mrs. White.", "They talked."],
    ["See Fig. 3 and Sec. 4.2 of Vol. 2.", "It is all there."],
    ["The answer is no.", "We tried it."],
    ["Version 1.2.3 is out.", "Get it now."],
    ["It costs approx. 5 euros, i.e. nothing.", "Buy it."],
    ["Use a tool, e.g. Make or CMake.", "Then build."],
    ["Smith et al. showed it.", "We agree."],
    ["It starts at 9 a.m. and ends at 5 p.m.", "Come early."],
    ["The meeting is on Jan. 5.", "Be there."],
    ["Apple Inc. said so.", "Google LLC did not."],
    ["J. R. R. Tolkien wrote it.", "C. S. Lewis read it."],
    ["He has a Ph.D. in physics.", "She has two."],
    ["Pods, nodes, etc. are objects.", "Learn them."],
    ["Pods, nodes, etc.", "Learn them all."],
    ["Call foo.bar() first.", "Then call baz()."],
    ["Set x = 0.5.", "Set y = 1."],
    ["This is it", ],
    ["Ist das z.B. richtig?", "Ja, d.h. fast."],
    ["Das kostet ca. 5 Euro.", "Das ist viel."],
    ["¿Dónde está?", "Está aquí."],
    ["Il est parti… et puis rien.", "Fin."],
    ["Wait… What?", ][:1] and ["Wait…", "What?"],
    ["これは文です。", "これも文です。"],
    ["The file is config.yaml.", "Edit it."],
    ["Say “Stop. Go back.” and wait.", "Then go."],
    ["See [the docs. They help.] before you start.", "Good luck."],
    ["It works (mostly).", "Sometimes it does not."],
    ["\"Done.\"", "He left."],
    ["Who is Mr. T?", "An actor."],
    ["It is 5 ft. tall.", ],
    ["In the D.C. area it rains.", "Often."],
    ["A vs. B is the question.", "C wins."],
    ["Run it twice!", "no", ][:1],
    ["The U.N. met.", "The E.U. did not."],
]


@pytest.mark.parametrize("parts", GOLDEN, ids=range(len(GOLDEN)))
def test_golden(parts):
    sep = "" if parts[0].endswith("。") else " "
    assert split(sep.join(parts)) == parts


def test_number_of_cases():
    assert len(GOLDEN) >= 60


def test_paragraphs_lists_and_headings():
    text = "# Title\n\nFirst line\ngoes on. Second.\n\n- one item\n- another. With two.\n1. numbered\n2. again\n\n(unclosed. Bracket"
    assert split(text) == ["# Title", "First line\ngoes on.", "Second.", "- one item", "- another.", "With two.", "1. numbered", "2. again", "(unclosed.", "Bracket"]
    assert split("") == split(" \n ") == []


def test_spans_cover_all_but_blanks():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["Mr. ", "word ", "A. ", "end. ", "\n", "\n\n", "(", ")", "\"", "? ", "...", "3.5 ", "e.g. ", "Next ", "。", "- "]) for _ in range(r.randint(0, 40)))
        own = spans(text)
        assert all(a < b for a, b in own) and all(b <= c for (_, b), (c, _) in zip(own, own[1:]))
        assert "".join(text[a:b] for a, b in own).split() == "".join(text.split()).split() or "".join("".join(text[a:b].split()) for a, b in own) == "".join(text.split())
        assert [(a + 2, b + 2) for a, b in own] == spans("xx" + text, 2)
