"""Facts, merging, answers and decoding on worked cases."""

import hashlib
import json
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import values
import __spark_entry__ as entry
from tessera import schemas as S, session
from tessera.functions import answers as N, facts as X, profile as V
from tessera.operators import access as A, discovery, facts as O, models as M, monitoring as Q, profiles as P
from tessera.plans.company_profile import discoveries_from_searches
from tessera.session import scratch_folder, staged
from tessera.sources import decode as D, stores as R


def test_products(spark):
    cases = {"X100": True, "5000X": True, "AB-123": True, "Ref. azul": True, "código": True, "parafuso": False, "": False, "1234": False, "refeição": False}
    assert values(spark, list(cases), X.is_product) == list(cases.values())


def test_service_label(spark):
    assert values(spark, ["Serviços de Sistemas da Casa", "subsistemas"], X.service_label) == ["serviço sistema casa", "subsistemas"]


def test_identity_routes(spark):
    texts = ["CNPJ 1", "12345678901", "Casa LTDA", "empresa boa", "fundada em 1990", "algo"]
    assert values(spark, texts, X.identity_field) == ["cnpj", "cnpj", "company_name", "company_name", "founding_year", "description"]
    # The literal rule finds "sa " in "empresa "; the whole-word rule does not.
    assert values(spark, texts, lambda c: X.identity_field(c, whole_word=True))[3] == "description"


def test_contact_routes(spark):
    texts = ["a@b.c", "2138480141", "(21) 3848-0141", "http://x", "Rua", "Rua Um"]
    assert values(spark, texts, X.contact_field) == ["emails", "phones", "locations", "website_url", None, "locations"]
    assert values(spark, texts, lambda c: X.contact_field(c, digits_first=True))[2] == "phones"


def fact(cnpj, chunk, place, section, value, quote="q", confidence=0.9, pages=("u",)):
    return (cnpj, chunk, place, section, value, quote, confidence, list(pages))


def test_bundles_and_merge(spark):
    rows = [fact("c", 1, i, "offerings", f"modelo {i}") for i in range(25)]
    rows += [
        fact("c", 1, 30, "contact", " A@B.c "), fact("c", 2, 1, "contact", "a@b.C"), fact("c", 2, 2, "contact", "https://s.example.com/?x=1"),
        fact("c", 2, 3, "identity", "a longer description"), fact("c", 3, 1, "identity", "tiny"), fact("c", 3, 2, "identity", "x" * 400, "q" * 400),
        fact("c", 3, 3, "identity", "  "), fact("c", 3, 4, "identity", "late", confidence=1.5), fact("c", 3, 5, "reputation", "Zed", "nosso cliente ISO"),
        fact("c", 3, 6, "reputation", "lost", "nothing here"), fact("c", 4, 1, "contact", "https://s.example.com/", pages=()),
    ]
    facts = O.bundle_facts(O.validate_facts(spark.createDataFrame(rows, S.FACT)))
    assert facts.where("section = 'offerings'").count() == 20
    assert facts.where("length(evidence_quote) = 320").count() == 1
    merged = O.merge_facts(facts, spark.createDataFrame([("c",), ("none",)], "cnpj_basico string"))
    by_key = {r.cnpj_basico: r for r in merged.collect()}
    m = by_key["c"]
    assert m.contact.emails == ["a@b.c"] and m.contact.website_url == "https://s.example.com"
    assert m.identity.description == "tiny" and m.reputation.client_list == ["Zed"]
    assert len(m.offerings.products) == 20 or len(m.offerings.services) == 20
    assert len(m.evidence_map["identity.description"]) == 3
    empty = by_key["none"]
    assert empty.identity.company_name is None and empty.contact.emails == [] and empty.evidence_map == {}
    built = {r.cnpj_basico: r.profile for r in P.build_profile(merged).collect()}
    assert built["c"].contact.website_url == "https://s.example.com" and built["none"].sources == []


def test_template_filter(spark):
    items = [("l", i, f"2 RCA + variante {i}") for i in range(12)] + [("l", 100 + i, f"item {i}") for i in range(60)]
    kept = O.anti_template(spark.createDataFrame(items, "k string, o long, v string"), "k", "o", "v").collect()
    assert len(kept) == 40 and sum(r.v.startswith("2 RCA") for r in kept) == 5


def profile_row(**sections):
    base = json.loads('{"identity":{},"classification":{},"team":{"key_roles":[],"team_certifications":[]},"offerings":{"products":[],"services":[],"engagement_models":[],"key_differentiators":[],"product_categories":[],"service_details":[]},"reputation":{"certifications":[],"awards":[],"partnerships":[],"client_list":[],"case_studies":[]},"contact":{"emails":[],"phones":[],"locations":[]},"sources":[]}')
    for name, part in sections.items():
        if isinstance(part, dict):
            base[name].update(part)
        else:
            base[name] = part
    return json.dumps(base)


def partials(spark, rows):
    df = spark.createDataFrame(rows, "cnpj_basico string, ord long, j string")
    return df.select("cnpj_basico", "ord", F.from_json("j", S.PROFILE).alias("profile"))


def test_merge_profiles(spark):
    rows = [
        ("c", 1, profile_row(identity={"company_name": "AB", "description": "faz parafusos"}, offerings={"products": [" p1 ", "p2", " "], "product_categories": [{"category_name": "Cat", "items": ["a"]}, {"category_name": "Geral", "items": []}]}, contact={"emails": ["late@x"]}, sources=["s1"])),
        ("c", 2, profile_row(identity={"company_name": "Longer name of the company", "description": "vende porcas e arruelas"}, offerings={"products": ["p2", "p3"], "services": ["s"] , "product_categories": [{"category_name": "Cat", "items": ["b", "a"]}], "service_details": [{"name": "N", "description": "um dois", "deliverables": ["d1"]}]}, contact={"emails": ["first@x"]}, sources=["s2", "s1"])),
        ("c", 3, profile_row(identity={"description": "parafusos"}, offerings={"service_details": [{"name": "N", "description": "tres quatro", "methodology": "m", "deliverables": ["d2", "d1"]}]}, reputation={"case_studies": [{"title": "T", "challenge": "x"}, {"title": "T", "challenge": "xyz"}]})),
        ("one", 1, profile_row(offerings={"products": [" kept as is "]})),
    ]
    out = {r.cnpj_basico: r.profile for r in P.merge_profiles(partials(spark, rows)).collect()}
    p = out["c"]
    # Profile 2 is the most complete one and leads.
    assert p.identity.company_name == "Longer name of the company"
    assert p.identity.description == "vende porcas e arruelas. faz parafusos"
    assert p.offerings.products == ["p2", "p3", "p1"] and p.contact.emails == ["first@x"]
    assert [(c.category_name, c["items"]) for c in p.offerings.product_categories] == [("Cat", ["b", "a"])]
    service = p.offerings.service_details[0]
    assert (service.description, service.methodology, service.deliverables) == ("um dois. tres quatro", "m", ["d1", "d2"])
    assert [c.challenge for c in p.reputation.case_studies] == ["xyz"]
    assert p.sources == ["s2", "s1"]
    assert out["one"].offerings.products == [" kept as is "]


def test_joining_texts():
    assert V.join_texts("", "b") == "b" and V.join_texts("a", "") == "a"
    assert V.join_texts("um dois", "tres quatro") == "um dois. tres quatro"
    assert V.join_texts("um dois", "um dois tres") == "um dois tres"
    assert V.join_texts("um dois tres", "dois um") == "um dois tres"
    assert V.join_texts("um dois", "dez mil") == "um dois. dez mil"


def test_flat_names(spark):
    rows = [("N", "t", "d"), (" ", " tag ", "d"), (None, None, "Faz. Mais"), (None, " ", ".x"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, t string, d string")
    got = df.orderBy("i").select(P.flat_name(F.col("n"), F.col("t"), F.col("d"), F.lit("123"))).collect()
    assert [g[0] for g in got] == ["N", "tag", "Faz", ".x", "Empresa CNPJ 123"]


def test_children_keep_old_rows_of_empty_lists(spark):
    rows = spark.createDataFrame([(1, profile_row(contact={"locations": [" a ", " "]})), (2, profile_row())], "company_id long, j string")
    profiles = rows.select("company_id", F.from_json("j", S.PROFILE).alias("profile"))
    old = spark.createDataFrame([(1, "old"), (2, "old")], "company_id long, location string")
    new = P.profile_children(profiles)["company_location"]
    kept = P.replace_children(old, new, profiles, "company_location").collect()
    assert {(r.company_id, r.location) for r in kept} == {(1, "a"), (2, "old")}


def test_json_extract(spark):
    texts = ['{"a": 1}', ' x ```json\n{"a": 2}\n``` y', '```\n[1]\n```', 'so {"a": {"b": 3}} and }', '{"a": ', "", "none"]
    got = values(spark, texts, N.json_extract)
    assert [g["json"] for g in got] == ['{"a": 1}', '{"a": 2}', "[1]", '{"a": {"b": 3}}', None, None, None]
    assert [g["reject_reason"] for g in got] == [None] * 4 + ["unparseable", "empty", "unparseable"]


def test_normalize_response_caps_and_enum(spark):
    wide = json.dumps({"offerings": {"products": [f"p{i}" for i in range(90)]}, "classification": {"business_model": "SaaS"}})
    p = values(spark, [wide, "[]", "3"], N.normalize_response)
    assert len(p[0].offerings.products) == 60 and p[0].classification.business_model == "SaaS"
    assert p[1] is None and p[2] is None


def test_discovery_rows(spark):
    hits = "array<struct<title:string,link:string,snippet:string>>"
    log = spark.createDataFrame(
        [("a", "q", [("t", "https://facebook.com", ""), ("t", "https://padaria.example.com", ""), ("t", "https://padaria.com.br", "")], 1),
         ("b", "q", [("t", "https://facebook.com", "")], 1), ("c", "q", [], 1), ("a", "old", [], 0)],
        f"cnpj_basico string, query_used string, results {hits}, created_at int",
    )
    names = spark.createDataFrame([("a", "Padaria"), ("b", "B")], "cnpj_basico string, name string")
    requests = spark.createDataFrame([(k,) for k in "abcd"], "cnpj_basico string")
    rows = {r.cnpj_basico: r for r in discoveries_from_searches(requests, log, names).collect()}
    assert rows["a"].website_url == "https://padaria.example.com" and rows["a"].confidence_score == 0.9
    assert [rows[k].llm_reasoning for k in "bcd"] == ["Todos os resultados foram filtrados (blacklist)", "Nenhum resultado de busca disponível", "Nenhum resultado Serper encontrado"]


def test_decoding(spark):
    bodies = [
        ("é".encode("utf-8"), None, "é"), ("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"),
        ("“é”".encode("cp1252"), "text/html; charset=windows-1252", "“é”"), (b'<meta charset="iso-8859-1">\xe9', None, '<meta charset="iso-8859-1">é'),
        (b"\xe9 broken", None, "é broken"), (b"%PDF-1.4", None, ""), (b"x", "application/pdf", ""), ("ş".encode("iso-8859-9"), "charset=ISO-8859-9; q", "ş"),
        (b'<meta http-equiv="Content-Type" content="text/html; charset=latin1">\xe9', "text/html", '<meta http-equiv="Content-Type" content="text/html; charset=latin1">é'),
        ("é".encode("utf-8"), "text/html; charset=unheard-of", "é"),
    ]
    df = spark.createDataFrame([(i, bytearray(b), c) for i, (b, c, _) in enumerate(bodies)], "i int, body binary, content_type string")
    got = [r.html for r in D.decode_pages(df).orderBy("i").collect()]
    assert got == [want for *_, want in bodies]


def test_binary_files_are_a_source(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("olá".encode("utf-8"))
    pages = D.read_binary_pages(spark, str(tmp_path)).withColumn("content_type", F.lit(None).cast("string"))
    assert [r.html for r in D.decode_pages(pages).collect()] == ["olá"]


def test_model_errors_reach_their_rows(spark):
    def broken(batch: pd.DataFrame):
        raise RuntimeError("model down")

    rows = spark.createDataFrame([(1, "p")], "id long, prompt string")
    out = M.model_map(M.with_call_settings(rows, F.lit(1), 4096), "id", broken).collect()
    assert out[0].content is None and out[0].error == "RuntimeError: model down"


def test_upsert_keeps_the_last_update(spark):
    from tessera.session import scratch_folder, staged

    folder = scratch_folder(spark, "test-upsert")
    shape = "k long, v string, ts long, tie long"
    R.upsert(spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], shape), folder, "k", "ts", "tie")
    R.upsert(spark.createDataFrame([(1, "c", 2, 1), (1, "d", 2, 2), (3, "e", 1, 1)], shape), folder, "k", "ts", "tie")
    assert {r.k: r.v for r in spark.read.parquet(folder).collect()} == {1: "d", 2: "b", 3: "e"}


def test_micros_does_not_depend_on_the_session_zone(spark):
    query = "SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS ts"
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert spark.sql(query).select(Q.micros(F.col("ts"))).first()[0] == 1710037800123456
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_first_pass_runs_once(spark, tmp_path):
    """One call per row and pass, and a model that never answers the same loses no row."""
    import random
    import uuid

    log = str(tmp_path)

    def call(batch):
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(f"{p} {t}" for p, t in zip(batch["prompt"], batch["temperature"])))
        return ["ab cd ef gh " * 60 if random.random() < 0.5 else "fine" for _ in range(len(batch))]

    rows = spark.range(200).select(F.col("id"), F.concat(F.lit("p"), F.col("id")).alias("prompt")).repartition(7)
    out = M.degenerate_retry(rows, "id", F.lit(100), 1000, call)
    got = out.collect()
    assert sorted(r.id for r in got) == list(range(200))
    assert all((r.content is None) == (r.failure == "loop") for r in got)
    calls = [line for p in tmp_path.iterdir() for line in p.read_text().split("\n")]
    first = [c for c in calls if c.endswith(f" {M.FIRST_TEMPERATURE}")]
    assert len(first) == 200 and len(set(first)) == 200


def test_retry_keeps_every_row_of_an_unsteady_source(spark):
    rows = spark.range(300).withColumnRenamed("id", "k")

    def unsteady(df):
        return df.select("k", F.lit("c").alias("content"), (F.rand() < 0.5).alias("ok"))

    got = discovery.retry_failed(rows, "k", unsteady, unsteady).collect()
    assert sorted(r.k for r in got) == list(range(300))


def test_model_answers_are_parsed(spark):
    rows = M.with_call_settings(spark.range(3).withColumn("prompt", F.lit("p")), F.lit(10), 100)
    out = M.model_map(rows, "id", lambda b: ['{"a": 1}'] * len(b), schema="a int").collect()
    assert all(r.parsed.a == 1 and r.latency_ms >= 0 for r in out)


def test_upserts_in_any_order(spark):
    folder = scratch_folder(spark, "test-order")
    batches = [[("a", 5, 1, "x"), ("b", 1, 1, "b1")], [("a", 10, 1, "new"), ("c", 1, 1, "c1")], [("a", 7, 1, "old"), ("b", 2, 1, "b2")]]
    for rows in (batches[1], batches[0], batches[2], batches[1]):
        R.upsert(spark.createDataFrame(rows, "k string, ts long, tie long, v string"), folder, "k", "ts", "tie")
    assert {(r.k, r.v) for r in spark.read.parquet(folder).collect()} == {("a", "new"), ("b", "b2"), ("c", "c1")}


def test_prefixes(spark):
    table = spark.createDataFrame([("abcdefgh", 1), ("abx", 2), ("", 3)], "key string, n int")
    asked = spark.createDataFrame([("ab",), ("abcdefgh",), ("",), ("abcdefghi",)], "p string")
    got = sorted((r.p, r.n) for r in R.prefix_join(asked, table, "p", "key").select("p", "n").collect())
    assert got == [("ab", 1), ("ab", 2), ("abcdefgh", 1)]


def test_nested_prefixes_over_partitions(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))) for _ in range(1500)] + ["abab" + "b" * 300] * 700 + [None]
    asked = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 6))) for _ in range(60)] + ["abab" + "b" * 290, "abab", None, "z"]
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int").repartition(5)
    lookups = spark.createDataFrame([(p, j) for j, p in enumerate(asked)], "p string, j int").repartition(3)
    got = sorted((r.p, r.j, r.n) for r in R.prefix_join(lookups, table, "p", "key").collect())
    assert got == sorted((p, j, i) for j, p in enumerate(asked) if p for i, k in enumerate(keys) if k and k.startswith(p))
    assert R.prefix_join(lookups.where("j < 0"), table, "p", "key").count() == 0
    assert R.prefix_join(lookups, table.where("n < 0"), "p", "key").columns == ["p", "j", "key", "n"]


def test_no_response(spark):
    rows = spark.createDataFrame([(None, None, None), ("x", None, 404)], "c string, e string, s int")
    got = [r[0] for r in rows.select(A.fetch_diagnosis(F.col("c"), F.col("e"), F.col("s"))).collect()]
    assert {(g.diagnosis, g.failure_type) for g in got} == {("no_response", "connection_error"), ("not_found", "empty_content")}


def test_joined_text_equals_joining_two_at_a_time():
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma", "delta", "Épsilon", "ΣΑΣ", "eta", "a", "x.", "İota"]
    for _ in range(400):
        held, plain = V.JoinedText(), ""
        for _ in range(rng.randrange(12)):
            text = rng.choice(["", " ", "  "]) + " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.randrange(7))) + rng.choice(["", " "])
            if rng.random() < 0.2 and plain:
                at = rng.randrange(len(plain))
                text = plain[at : at + rng.randrange(1, 30)]
            held, plain = held.add(text), V.join_texts(plain, text)
            assert held.text == plain


def test_one_company_of_many_texts(spark):
    """A hundred thousand texts of one company: no text passes through the driver."""
    n = 100_000
    profile = F.from_json(
        F.concat(F.lit('{"identity": {"description": "'), F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id")) for w in "abcd"]), F.lit('"}}')), S.PROFILE
    )
    ranked = spark.range(n, numPartitions=8).select(
        F.lit("1").alias("cnpj_basico"), F.struct(F.lit(True).alias("later"), F.col("id").alias("ord")).alias("turn"), F.lit(n).alias("n_partials"), profile.alias("profile")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    try:
        row = P.joined_texts(ranked).where("field = 'description'").select(F.length("value").alias("n"), F.md5("value").alias("h")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = ". ".join(" ".join(f"{w}{i}" for w in "abcd") for i in range(n))
    assert (row.n, row.h) == (len(whole), hashlib.md5(whole.encode()).hexdigest())


def test_best_supported_value(spark):
    """Confidence first, then chunks, then the page, then the first place."""
    def fact(chunk, ord_, value, confidence, path):
        return ("c", chunk, ord_, "identity", value, f"{value} quote", confidence, [f"https://x.example.com{path}"])

    shape = "cnpj_basico string, chunk_index long, ord long, section string, value string, evidence_quote string, confidence double, page_source array<string>"

    def best(*facts):
        row = O.best_supported(O.routed(spark.createDataFrame(list(facts), shape))).first()
        return row.value, row.confidence, row.chunks, row.page_rank

    assert best(fact(1, 0, "A Ltda", 0.7, "/sobre"), fact(2, 0, "B Ltda", 0.9, "/x")) == ("B Ltda", 0.9, 1, 5)
    assert best(fact(1, 0, "A Ltda", 0.9, "/sobre"), fact(2, 0, "B Ltda", 0.9, "/x"), fact(3, 0, "b ltda", 0.1, "/y")) == ("B Ltda", 0.9, 2, 5)
    assert best(fact(1, 0, "A Ltda", 0.9, ""), fact(1, 1, "a ltda", 0.9, "/servicos"), fact(2, 0, "B Ltda", 0.9, "/contato")) == ("B Ltda", 0.9, 1, 2)
    assert best(fact(2, 0, "A Ltda", 0.9, "/a"), fact(1, 5, "B Ltda", 0.9, "/b")) == ("B Ltda", 0.9, 1, 5)


def test_page_ranks(spark):
    urls = ["https://x/quem-somos", "https://x/fale/contato?sobre", "https://x", "https://x/#sobre", "https://x/Servicos/a", "https://x/blog", None]
    assert values(spark, urls, lambda c: F.coalesce(O.page_rank(c), F.lit(0))) == [1, 2, 3, 3, 4, 5, 5]


def test_texts_that_are_not_held_are_not_searched_for(monkeypatch):
    """Thousands of texts that share their inner words: a search reads the whole joined text."""
    searched = []
    monkeypatch.setattr(V.JoinedText, "_holds", lambda self, low: searched.append(low) or low.encode() in self.low)
    held = V.JoinedText()
    texts = [f"{i * 7919:032x} {'pt en es fr'.split()[i % 4]} {i % 5}" for i in range(3000)]
    for text in texts:
        held.add(text)
    assert len(searched) < 300 and len(held.text) > 90_000
    before = held.text
    for text in (texts[700], texts[1500][-9:] + ". " + texts[1501][:20]):
        assert text in before and held.add(text).text == before


def test_profiles_of_few_companies_are_ranked_where_they_lie(spark):
    """The bases are few and written, so the planner does not shuffle the profiles to them."""
    profile = F.from_json(F.concat(F.lit('{"identity": {"description": "'), F.repeat(F.lit("word "), 400), F.col("id"), F.lit('"}}')), S.PROFILE)
    partials = spark.range(3000, numPartitions=4).select((F.col("id") % 3).cast("string").alias("cnpj_basico"), F.col("id").alias("ord"), profile.alias("profile"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)
    try:
        ranked = P.ranked_profiles(partials)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert ranked.where("not turn.later").count() == 3 and ranked.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_evidence_reads_its_facts_once(spark):
    """Identity and list fields take the same written routes; the documents are not routed twice."""
    out = entry.queries()["evidence_map"](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "documents" in f]


def test_united_lists_against_a_plain_pass(spark):
    """Equal names in one profile, blanks, values that differ in white space, and places at the ends of 64 bits."""
    rng = random.Random(8)
    values_of = lambda: [rng.choice(["", " "]) + rng.choice(["a", "b", "c d", "", "é"]) + rng.choice(["", "\t", str(rng.randrange(9))]) for _ in range(rng.randrange(6))]
    rows, plain = [], {}
    for c in "xy":
        for at, ord_ in enumerate([-(2**63), -(2**63) + 1, -1, 0, 7, 2**63 - 1]):
            cats = [{"category_name": rng.choice(["A", "B", "Geral", ""]), "items": values_of()} for _ in range(4)]
            services = [{"name": rng.choice("NM"), "deliverables": values_of()} for _ in range(4)]
            products = values_of() + ["filler"] * (50 if at == 3 else 0)
            rows.append((c, ord_, profile_row(offerings={"products": products, "product_categories": cats, "service_details": services})))
            plain.setdefault(c, []).append((at != 3, ord_, products, cats, services))

    def united(lists):
        return list(dict.fromkeys(v.strip() for items in lists for v in items if v.strip()))

    got = {r.cnpj_basico: r.profile.offerings for r in P.merge_profiles(partials(spark, rows)).collect()}
    for c, parts in plain.items():
        parts.sort(key=lambda p: p[:2])
        assert got[c].products == united(p[2] for p in parts)
        names = list(dict.fromkeys(x["category_name"] for p in parts for x in p[3] if x["category_name"] in "AB" and x["category_name"]))
        assert [(x.category_name, x["items"]) for x in got[c].product_categories] == [
            (n, united(x["items"] for p in parts for x in p[3] if x["category_name"] == n)) for n in names
        ]
        names = list(dict.fromkeys(x["name"] for p in parts for x in p[4]))
        assert [(x.name, x.deliverables) for x in got[c].service_details] == [
            (n, united(x["deliverables"] for p in parts for x in p[4] if x["name"] == n)) for n in names
        ]


def test_places_of_values_are_whole_numbers(spark):
    """No decimal is built and no text trimmed per value before repeats are gone."""
    ranked = P.ranked_profiles(partials(spark, [("c", 1, profile_row()), ("c", 2, profile_row())]))
    plan = P.merge_lists(ranked)._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan.lower()
    assert "trim" not in plan[plan.index("Generate") :]


def test_parts_of_a_merge_read_their_fields_only(spark):
    """The long lists of categories and services are read where they are united, not for the names beside them."""
    rows = [
        ("c", 1, profile_row(offerings={"product_categories": [None, {"category_name": "A", "items": ["x"]}, {"category_name": "B"}], "service_details": [{"name": "N", "deliverables": ["d", "e"]}, None]})),
        ("c", 2, profile_row(offerings={"product_categories": None, "service_details": [{"name": "N", "methodology": "m", "deliverables": ["f", "d"], "ideal_client_profile": "i"}, {"name": None, "deliverables": ["g"]}]})),
        ("c", 3, profile_row(offerings={"product_categories": [{"category_name": "B", "items": ["y"]}, {"category_name": "A", "items": ["z", "x"]}], "service_details": None})),
    ]
    ranked = P._placed(staged(P._scored(partials(spark, rows)), "scored", dictionary=False))

    def readers(df, field):
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(f'"{field}"' in leaves.apply(i).schema().json() for i in range(leaves.size()))

    categories, services = P.merge_categories(ranked), P.merge_services(ranked, P.joined_texts(ranked))
    assert readers(categories, "items") == 1 and readers(services, "deliverables") == 1
    assert readers(P._service_rows(ranked, "description", "methodology"), "deliverables") == 0
    assert [(c.category_name, c["items"]) for c in categories.first().product_categories] == [("A", ["x", "z"]), ("B", ["y"])]
    assert [(s.name, s.methodology, s.deliverables, s.ideal_client_profile) for s in services.first().service_details] == [("N", "m", ["d", "e", "f"], "i")]
    assert {r.field for r in P.merge_lists(ranked).collect()} <= set(P.UNION_FIELDS)


def test_keyed_structs_of_every_kind(spark):
    """The query gives categories, services and cases, with texts joined, lists united and the first seen first."""
    rows = [
        ("c", 1, profile_row(offerings={"product_categories": [{"category_name": "A", "items": ["x"]}, {"category_name": "geral", "items": ["g"]}], "service_details": [{"name": "N", "description": "one two", "deliverables": ["d"]}]})),
        ("c", 2, profile_row(offerings={"service_details": [{"name": "M", "methodology": "m"}, {"name": "N", "description": "three four", "deliverables": ["e", "d"]}]}, reputation={"case_studies": [{"title": "T", "challenge": "short"}, {"title": "U"}]})),
        ("c", 3, profile_row(offerings={"product_categories": [{"category_name": "A", "items": ["y", "x"]}]}, reputation={"case_studies": [{"title": "T", "challenge": "longer", "client_name": "k"}]})),
        ("d", 1, profile_row(reputation={"case_studies": [{"title": "V", "outcome": "o"}]})),
    ]
    got = {r.cnpj_basico: r for r in P.merge_keyed_structs(P.ranked_profiles(partials(spark, rows))).collect()}
    assert [(c.category_name, sorted(c["items"])) for c in got["c"].product_categories] == [("A", ["x", "y"])]
    services = {s.name: (s.description, s.methodology, sorted(s.deliverables)) for s in got["c"].service_details}
    assert services["N"][2] == ["d", "e"] and services["M"][1] == "m"
    assert services["N"][0] in ("one two. three four", "three four. one two")
    assert {k.title: (k.client_name, k.challenge) for k in got["c"].case_studies} == {"T": ("k", "longer"), "U": (None, None)}
    assert got["d"].product_categories == [] and [(k.title, k.outcome) for k in got["d"].case_studies] == [("V", "o")]
    kinds = entry.queries()["merge_keyed_structs"](spark, "/root/testdata/sf0.001").groupBy("kind").count().collect()
    assert {r.kind for r in kinds} == {"category", "service", "case"}


def test_merge_writes_no_copy_of_the_partials(spark):
    """What a merge leaves in the shared folder grows with what it keeps, not with what it reads."""
    rng = random.Random(11)
    words = [f"{rng.randrange(10**9):09d}" for _ in range(20_000)]
    rows = [("c", i, profile_row(offerings={"products": rng.sample(words, len(words))})) for i in range(30)]
    read, before = sum(len(r[2]) for r in rows), len(session._scratch)
    (merged,) = P.merge_profiles(partials(spark, rows)).collect()
    assert sorted(merged.profile.offerings.products) == sorted(set(words))
    files = spark._jvm.org.apache.hadoop.fs
    written = 0
    for folder in session._scratch[before:]:
        path = files.Path(folder)
        written += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    assert written < read / 10


def test_values_of_a_key_go_by_as_a_stream():
    """Keys over many batches, keys without a value, and values that differ in white space only."""
    kind = pa.schema([("c", pa.string()), ("n", pa.string()), ("value", pa.string())])
    rows = [(None, "a", "x"), (None, "a", " x "), ("c", None, "y"), ("c", None, " "), ("c", "a", " z"), ("c", "a", "z"), ("c", "a", "w"), ("d", "a", " ")]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows[i : i + size]], kind) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in P._united(["c", "n"])(iter(batches)) for r in b.to_pylist()]
        assert got == [(None, "a", ["x"]), ("c", None, ["y"]), ("c", "a", ["z", "w"]), ("d", "a", [])]


def test_profiles_are_put_together_once(spark):
    """A company's row, with all its lists, goes through no join or aggregate; its parts may come in any batches."""
    rows = [("c", i, profile_row(offerings={"products": [f"p{i}"]}, sources=["s"])) for i in (1, 2)]
    plan = P.merge_profiles(partials(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
    # The only join finds the companies with a single partial.
    assert plan.count("Join") == 1
    kind = pa.schema([("cnpj_basico", pa.string()), ("a", pa.list_(pa.string())), ("b", pa.string())])
    parts = [("c", ["x", "y"], None), ("c", None, "t"), ("d", None, None), ("e", None, "u")]
    for size in (1, 2, 3, 4):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in parts[i : i + size]], kind) for i in range(0, len(parts), size)]
        put = P._put_together(["a", "b"], {"s": {"a": "a", "t": "b"}, "b": "b"})
        got = [tuple(r.values()) for b in put(iter(batches)) for r in b.to_pylist()]
        assert got == [("c", {"a": ["x", "y"], "t": "t"}, "t"), ("d", {"a": [], "t": None}, None), ("e", {"a": [], "t": "u"}, "u")]
