"""The language stage on real prose: what is in a taught language stays, what is not goes."""

import pyarrow.dataset
import pytest

from spoolsight.llm import langid_crf
from spoolsight.session import ship_package

KNOWN = {
'en':["It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife. However little known the feelings or views of such a man may be on his first entering a neighbourhood, this truth is so well fixed in the minds of the surrounding families, that he is considered as the rightful property of some one or other of their daughters.",
"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and to permit persons to whom the software is furnished to do so.",
"All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
"The scheduler keeps a queue of pending jobs per worker. When a worker finishes, it pulls the next job; if its queue is empty it steals from the longest queue. Latency percentiles are exported as metrics, and the dashboard shows throughput, retries and failures.",
"Call me Ishmael. Some years ago, never mind how long precisely, having little or no money in my purse, and nothing particular to interest me on shore, I thought I would sail about a little and see the watery part of the world."],
'fr':["Longtemps, je me suis couché de bonne heure. Parfois, à peine ma bougie éteinte, mes yeux se fermaient si vite que je n'avais pas le temps de me dire : je m'endors. Et, une demi-heure après, la pensée qu'il était temps de chercher le sommeil m'éveillait.",
"Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
"Nous étions à l'étude, quand le proviseur entra, suivi d'un nouveau habillé en bourgeois et d'un garçon de classe qui portait un grand pupitre. Ceux qui dormaient se réveillèrent, et chacun se leva comme surpris dans son travail."],
'de':["Als Gregor Samsa eines Morgens aus unruhigen Träumen erwachte, fand er sich in seinem Bett zu einem ungeheueren Ungeziefer verwandelt. Er lag auf seinem panzerartig harten Rücken und sah, wenn er den Kopf ein wenig hob, seinen gewölbten, braunen Bauch.",
"Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
"Jemand musste Josef K. verleumdet haben, denn ohne dass er etwas Böses getan hätte, wurde er eines Morgens verhaftet. Die Köchin der Frau Grubach, seiner Zimmervermieterin, die ihm jeden Tag gegen acht Uhr früh das Frühstück brachte, kam diesmal nicht."],
'es':["En un lugar de la Mancha, de cuyo nombre no quiero acordarme, no ha mucho tiempo que vivía un hidalgo de los de lanza en astillero, adarga antigua, rocín flaco y galgo corredor.",
"Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
"Juventud, divino tesoro, ya te vas para no volver. Cuando quiero llorar, no lloro, y a veces lloro sin querer. Plural ha sido la celeste historia de mi corazón."],
}
OTHER = {
'fi':["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."],
'pl':["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."],
'tr':["Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."],
'cs':["Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství."],
'hu':["Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek."],
'ru':["Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."],
'el':["Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα."],
'ja':["すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。"],
'sv':["Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap."],
'it':["Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza."],
'shuffled':["zzyq xwvk qqjx vvkz kjhq wqxz vbnk qzxw jjqk wxyz qqvv kkxz"],
}


@pytest.fixture(scope="module", params=[50, 250])
def model(request):
    """Fitted to so many texts a language of the tables."""
    table = pyarrow.dataset.dataset("/root/testdata/sf0.1/documents.parquet").to_table(columns=["text", "lang"])
    sample = {}
    for text, lang in zip(table["text"].to_pylist(), table["lang"].to_pylist(), strict=True):
        if text and lang and len(sample.setdefault(lang, [])) < request.param:
            sample[lang].append((text, lang))
    model = langid_crf.train([row for rows in sample.values() for row in rows])
    model.texts = request.param
    return model


def kept(spark, rows, model, **options):
    ship_package(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, own string")
    return {r.doc_id: r.lang for r in langid_crf.keep_identified(docs, model, lang_col="lang", **options).collect()}


def test_prose_in_taught_languages_stays_and_other_goes(spark, model):
    prose = [(lang, text) for lang, texts in KNOWN.items() for text in texts]
    other = [(lang, text) for lang, texts in OTHER.items() for text in texts]
    rows = [(k, text, None, "x") for k, (_, text) in enumerate([*prose, *other])]
    got = kept(spark, rows, model)
    stayed = {k for k in got if k < len(prose)}
    assert all(got[k] == prose[k][0] for k in stayed) and len(stayed) >= len(prose) - (2 if model.texts < 250 else 0)  # with few texts two French ones are unsure
    assert len([k for k in got if k >= len(prose)]) <= (1 if model.texts < 250 else 0) and not any(other[k - len(prose)][0] in ("ru", "el", "ja", "shuffled") for k in got if k >= len(prose))


def test_a_language_that_is_given_and_agrees_is_never_dropped(spark, model):
    """Short and odd texts in it stay; another script with a wrong language does not."""
    rows = [(1, KNOWN["fr"][0], "fr", "x"), (2, "The lock, mutex and semaphore API.", "en", "x"), (3, OTHER["ru"][0], "en", "x"), (4, OTHER["ja"][0], "es", "x"), (5, None, "en", "x"), (6, "12 34", "en", "x")]
    assert set(kept(spark, rows, model, min_score=0.99, min_familiar=0.99)) == {1, 2}


def test_switched_text_stays(spark, model):
    """All four languages in turn: no language has half of it, but all of it is known."""
    table = pyarrow.dataset.dataset("/root/testdata/sf0.1/documents.parquet").to_table(columns=["text", "lang"])
    each = {}
    for text, lang in zip(table["text"].to_pylist(), table["lang"].to_pylist(), strict=True):
        if text and lang and len(text.split()) > 80:
            each.setdefault(lang, " ".join(text.split()[:60]))
    assert set(kept(spark, [(1, " ".join(each.values()), None, "x")], model)) == {1}
