"""Each stage of the pipeline on what the one before kept, against brute force."""

import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def documents(spark):
    rnd = random.Random(2)
    vocab = {"en": "the and of that with thing erly tion".split(), "es": "el de que ción los ado para ñu".split()}
    say = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", rnd.choice(vocab[lang]), str(rnd.randint(0, 9))]) for _ in range(n))
    data = [(k, say(lang, rnd.randint(5, 80)), lang, f"s{k % 3}", 0) for k, lang in enumerate(["en", "es"] * 60)]
    data += [(400, "Все люди рождаются свободными и равными", None, "s1", 0), (401, "kaikki ihmiset syntyvät vapaina ja tasavertaisina", None, "s1", 0), (402, data[0][1] + " and that", None, "s1", 0)]
    data += [(200 + k, data[k][1].replace(" ", "  "), "en", "s1", 0) for k in range(8)] + [(300, None, None, None, 0), (301, "12 34", "en", None, 0), (302, "", "es", "s2", 0)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = documents(spark)
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, kept[-1], "").write.parquet(out)
        kept.append(spark.read.parquet(out))
    assert len(corpus_pipeline.STAGES) == 5 and all(df.columns == docs.columns for df in kept[:5])
    ids = [[r.doc_id for r in df.collect()] for df in kept]
    assert set(ids[0]) - set(ids[1]) == {300, 301, 302, 400, 401}  # no letters, or in no language that is taught
    assert [r.lang for r in kept[1].where("doc_id = 402").collect()] == ["en"]
    assert set(ids[1]) - set(ids[2]) == {200 + k for k in range(8)} and len(ids[2]) == len(set(ids[2]))
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[4]).values()) <= 2 and set(ids[4]) <= set(ids[3])
    size = {r.doc_id: (r.source, len(re.findall(r"\S+", r.text))) for r in kept[3].collect()}
    whole, took = Counter(), Counter()
    for s, n in size.values():
        whole[s] += n
    for i in ids[4]:
        took[size[i][0]] += size[i][1]
    assert abs(sum(took.values()) - 1.5 * sum(whole.values())) <= 10 and all(took[s] <= 2 * whole[s] for s in whole)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in kept[3].collect()}
    assert Counter((r.doc_id, tuple(r.ids)) for r in kept[5].collect()) == Counter((i, tuple(library.encode(text[i], add_special_tokens=False).ids)) for i in ids[4])


def test_run_reads_documents(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 100 and got.columns[:3] == ["doc_id", "ids", "n_tokens"]


def test_empty_corpus(spark):
    docs = documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
