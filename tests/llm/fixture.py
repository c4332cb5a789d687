"""Small tables with every kind of dirt: nulls in any column, empty and very long texts, ties, repeats, extra columns."""


ITEMS = "id string, source_id string, source_name string, tier int, grp string, title string, canonical_title string, summary string, url string, lang string, published_ts long, fetched_ts long, simhash long, cluster_id string, body string, body_state string, body_ts long"
CLUSTERS = "id string, headline string, headline_src string, rank double, updated_ts long"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, kind string, title string, item_id string"
LABELS = "doc_id long, annotator string, label string"
SAMPLES = "sample_id long, lang string, text string"
TARGETS = "source string, target_share double, max_repeats int"
#: Names that the operators use inside; as extra columns of the input they must do no harm.
CLASHES = ["key", "text", "rep", "field", "score", "contributor", "cap", "n", "word", "ch", "pos", "leaf", "size", "ids", "block", "uniform", "kind", "at"]


def rows(schema, values):
    names = [c.strip().split()[0] for c in schema.split(",")]
    return [tuple(v.get(n) for n in names) for v in values]


def write(spark, folder, name, schema, values, clashes=True):
    df = spark.createDataFrame(rows(schema, values), schema)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})
    df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


LONG = "The board of the company approved a budget for the plant and the work goes on. "


def items():
    out = []
    for i in range(60):
        out.append({"id": f"{i:020x}", "source_id": [" Big ", "big", "BIG"][i % 3] if i < 40 else f"s{i % 4}", "title": f"Central bank in Town{i} holds rate and warns on risks", "summary": LONG * 4 + f"Item {i} has its own words, alpha{i} beta{i}.",
                    "lang": "en", "fetched_ts": 1000 + i, "cluster_id": f"c{i % 7}", "body": f"Home\nNews\n\n{LONG}\nWhat happens next\n{LONG * 2}\nBack to top", "body_state": "ok"})
    out += [dict(out[3]), {**out[4], "fetched_ts": 5000}, {**out[5]}]  # repeats
    out += [{"id": None, "title": "no id", "summary": "no id", "body": "x", "body_state": "ok"}, {"id": "all-null"}, {"id": "empty", "source_id": "", "title": "", "summary": "", "lang": "", "body": "", "body_state": "ok", "cluster_id": ""}]
    out += [{"id": "blank", "source_id": None, "title": "  ", "summary": " \n ", "lang": " ", "body": "\n\n \n", "body_state": "ok"}]
    out += [{"id": "long", "source_id": "s1", "title": "word " * 40_000, "summary": LONG * 3_000, "body": (LONG + "\n") * 3_000, "body_state": "ok", "lang": "en"}]
    out += [{"id": "one-char", "source_id": "s1", "title": "a", "summary": "b", "body": "c", "body_state": "ok", "lang": "en"}]
    return out


def clusters():
    return [{"id": f"c{k}", "rank": r, "updated_ts": 10} for k, r in enumerate([0.5, 0.5, None, 0.9, float("nan"), 0.1])] + [{"id": "c0", "rank": 0.0, "updated_ts": 1}, {"id": "c0", "rank": 0.5, "updated_ts": 10}, {"id": None, "rank": 1.0}]


def documents():
    good = [{"doc_id": i, "text": f"The report lists {i} open questions.\nSuppliers expect {i} contracts.\nThe plant employs {i} people.", "source": f"src{i % 3}", "lang": "en"} for i in range(60)]
    bad = [{"doc_id": 100 + i, "text": f"The report lists {i} open questions.\nYou are a worthless stupid idiot, shut up!", "source": "src1", "lang": "en"} for i in range(20)]
    odd = [{"doc_id": 200, "text": None}, {"doc_id": 201, "text": ""}, {"doc_id": 202, "text": "  \n "}, {"doc_id": 203, "text": "naïve 中文字 😀 <|endoftext|>\u0000 'll  \n\n x", "source": " SRC0 "}, {"doc_id": 204, "text": "long word " * 20_000, "source": "src2"}, {"doc_id": 205, "text": "a" * 3_000}]
    return good + bad + odd


def labels():
    out = [{"doc_id": i, "annotator": "a", "label": "ok"} for i in range(40)] + [{"doc_id": 100 + i, "annotator": "a", "label": "abusive"} for i in range(12)]
    return out + [{"doc_id": 100, "annotator": "b", "label": "ok"}, {"doc_id": None, "annotator": "b", "label": "ok"}, {"doc_id": 3, "annotator": None, "label": None}, {"doc_id": 9999, "label": "abusive"}]


SENTENCES = {
    "en": ["The bank holds the rate and warns on the risks", "A court fines the company for late reports", "Suppliers expect new contracts this year", "The ministry wants new rules before July"],
    "de": ["Die Bank lässt den Zins stehen und warnt vor der Lage", "Ein Gericht verhängt gegen die Firma eine Strafe", "Zulieferer rechnen in diesem Jahr mit neuen Verträgen", "Das Ministerium möchte vor dem Juli neue Regeln"],
    "fr": ["La banque garde son taux et alerte sur les risques", "Un tribunal inflige une amende à la société", "Les fournisseurs espèrent de nouveaux contrats cette année", "Le ministère veut de nouvelles règles avant juillet"],
    "es": ["El banco mantiene el tipo y advierte sobre los riesgos", "Un tribunal multa a la empresa por sus informes", "Los proveedores esperan contratos nuevos este año", "El ministerio quiere nuevas normas antes de julio"],
    "pt": ["O banco mantém a taxa e alerta para os riscos", "Um tribunal multa a empresa por causa dos relatórios", "Os fornecedores esperam novos contratos neste ano", "O ministério quer novas regras antes de julho"],
    "zh": ["央行维持利率不变，提示风险", "法院因报告迟交对公司罚款", "供应商预计今年新增合同", "主管部门希望在七月前出台新规"],
}


def samples():
    return [{"sample_id": n, "lang": lang, "text": s} for n, (lang, s) in enumerate((lang, s) for lang, ss in SENTENCES.items() for s in ss)] + [{"sample_id": 99, "lang": None, "text": "x"}, {"sample_id": 98, "lang": "en", "text": None}]


def targets():
    return [{"source": "src0", "target_share": 0.5, "max_repeats": 2}, {"source": "src1", "target_share": 0.3, "max_repeats": 3}, {"source": "silent", "target_share": 0.2, "max_repeats": 4}, {"source": "src2", "target_share": None, "max_repeats": None}]


def dirty(spark, folder, more_items=()):
    write(spark, folder, "items", ITEMS, items() + list(more_items))
    write(spark, folder, "clusters", CLUSTERS, clusters())
    write(spark, folder, "documents", DOCUMENTS, documents())
    write(spark, folder, "doc_labels", LABELS, labels())
    write(spark, folder, "lang_samples", SAMPLES, samples())
    write(spark, folder, "mix_targets", TARGETS, targets())


def empty(spark, folder):
    for name, schema in (("items", ITEMS), ("clusters", CLUSTERS), ("documents", DOCUMENTS), ("doc_labels", LABELS), ("mix_targets", TARGETS)):
        write(spark, folder, name, schema, [], clashes=False)
    write(spark, folder, "lang_samples", SAMPLES, samples(), clashes=False)


