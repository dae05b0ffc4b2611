"""The pipeline's near duplicates are linked by the fingerprints of op 7 too, not by shingle sets alone."""

import corpus_pipeline
from spoolsight.llm import near_copies, simhash_links


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    texts = [line, f"{line} {line} {line}", f"{line} {line} {line} ten", "quite another text about something else", "one two three"]
    near = " ".join(f"w{k}" for k in range(400))
    texts += [near, near.replace("w200 ", ""), near.replace("w200 ", "").replace("w100 ", "")]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(90, None), (91, "")], "doc_id long, text string")
    bits = {r.doc_id: r.component_id for r in simhash_links.near_duplicates(docs).collect()}
    sets = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
    assert bits[0] == bits[1] and sets[0] != sets[1]  # the case that the sets do not link
    kept = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, "")
    group = {i: i for i in bits}
    for a in bits:
        for b in bits:
            if bits[a] == bits[b] or sets[a] == sets[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))
