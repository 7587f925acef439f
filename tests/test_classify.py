import json

import pytest
from pyspark.sql import functions as F

from sitescan import lookups
from sitescan.functions import labels, languages, replies
from sitescan.functions.json_text import plain_json
from sitescan.functions.replies import BAD_ITEM, EMPTY_REPLY, INVALID_REPLY, MISSING_ITEM, NO_REPLY, NOT_AN_ARRAY
from sitescan.operators import classify
from sitescan.samples import LANGUAGES


def test_unfence(evaluate):
    cases = {
        "[1]": "[1]", "```json\n[1]\n```": "[1]", "```\n[1]```": "[1]", "  ```[1]```  ": "[1]",
        "```js x y\n[1]": "[1]", "[1]\n```": "[1]", "``````": "", "": "",
    }
    assert evaluate(replies.unfence, *cases) == list(cases.values())


def test_scores(evaluate):
    score = lambda c: replies.clamp_score(F.try_parse_json(c), "$.confidence.niche")
    cases = {
        "85": 85, '"85"': 85, "85.9": 85, '"85.5"': 0, "true": 1, "null": 0, "140": 100, "-3": 0,
        '"abc"': 0, "1e30": 100, "[5]": 0, '{"a":1}': 0,
    }
    items = ['{"confidence":{"niche":%s}}' % c for c in cases]
    assert evaluate(score, *items) == list(cases.values())
    assert evaluate(score, '{"confidence":5}', "{}", '{"confidence":null}') == [0, 0, 0]


def test_site_type(evaluate):
    cases = {"blog": "Blog", "E-COMMERCE": "E-commerce", "Forum": "Unknown", "": "Unknown", None: "Unknown", "unknown": "Unknown"}
    assert evaluate(replies.site_type, *cases) == list(cases.values())


def item(url, **more):
    return {"url": url, "niche": "N", "site_type": "blog", "language": "English (en)", "author": None,
            "confidence": {"niche": 50, "site_type": 60, "language": 70, "author": 0}, **more}


def read(rows, requests, *texts):
    table = rows("batch_id bigint, url string", *requests)
    answers = rows("batch_id bigint, reply string", *texts)
    return {r.url: r for r in classify.read_replies(table, answers).collect()}


def test_replies(rows):
    fenced = "```json\n" + json.dumps([
        item("a", niche="old"), 7, "x", item("a", niche="new"), item("foreign"),
        item("c", niche=5), {"niche": "no url"}, item("d", confidence="high", site_type=3),
    ]) + "\n```"
    got = read(
        rows,
        [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "e"), (3, "f"), (4, "g"), (5, "h"), (5, "i")],
        (1, fenced), (2, "nope"), (3, '{"a":1}'), (4, "  "),
    )
    assert set(got) == set("abcdefghi")
    assert (got["a"].niche, got["a"].site_type, got["a"].ai_error) == ("new", "Blog", None)
    assert got["b"].ai_error == MISSING_ITEM and got["b"].site_type == "Unknown"
    assert got["c"].ai_error == BAD_ITEM and got["c"].language == "English (en)"
    assert tuple(got["d"].confidence) == (0, 0, 0, 0) and got["d"].site_type == "Unknown"
    assert [got[u].ai_error for u in "efghi"] == [INVALID_REPLY, NOT_AN_ARRAY, EMPTY_REPLY, NO_REPLY, NO_REPLY]


def test_repeated_keys_and_numbers_that_are_none_spoil_nothing(rows):
    first = '[{"url":"a","niche":"stale","niche":"N","score":NaN,"confidence":{"niche":10,"niche":55,"author":-Infinity}},{"url":"b","site_type":"News"}]'
    got = read(rows, [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")], (1, first), (2, '{"a":1,"a":NaN}'), (3, '[{"url":"d"},{"url":"d","x":NaN}'), (4, '[{"url":"e"}] end'))
    assert (got["a"].niche, got["a"].confidence.niche, got["a"].confidence.author, got["a"].ai_error) == ("N", 55, 0, None)
    assert (got["b"].site_type, got["b"].ai_error) == ("News", None)
    # What Python's reader refuses too stays refused.
    assert [got[u].ai_error for u in "cde"] == [NOT_AN_ARRAY, INVALID_REPLY, INVALID_REPLY]


def test_plain_json():
    assert plain_json('{"a": 1, "a": [NaN, {"b": 1, "b": "é"}]}') == '{"a": [null, {"b": "é"}]}'
    assert [plain_json(t) for t in ('{"a": 1}', "[1, 2]", "", "NaN]", '{"a":', "[" * 100_000)] == [None] * 6
    assert plain_json("-Infinity") == "null"


def test_a_url_in_two_batches_gives_one_row(rows):
    two = [(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "b"), (1, "c"), (2, "c"), (2, "c")]
    got = rows("batch_id bigint, url string", *two)
    answers = rows("batch_id bigint, reply string", (1, json.dumps([item("a", niche="1"), item("b", niche="1")])), (2, json.dumps([item("b", niche="2")])))
    found = classify.read_replies(got, answers).collect()
    assert sorted((r.url, r.niche, r.ai_error) for r in found) == [("a", "1", None), ("b", "2", None), ("c", None, MISSING_ITEM)]


def test_reasons_of_failed_calls_are_carried(rows):
    asked = rows("batch_id bigint, url string", (1, "a"), (2, "b"), (3, "c"), (4, "d"))
    replies_ = rows("batch_id bigint, reply string, error string", (1, None, "rate limit"), (2, "nope", None), (3, json.dumps([item("c")]), ""), (4, None, None))
    got = {r.url: r.ai_error for r in classify.read_replies(asked, replies_).collect()}
    assert got == {"a": "rate limit", "b": INVALID_REPLY, "c": None, "d": EMPTY_REPLY}
    errors = {r.url: r.batch_error for r in classify.batch_error_spread(asked, replies_).collect()}
    assert errors["a"] == "rate limit"


def facts(rows, *pages):
    schema = (
        "url string, title string, meta_description string, body_text string, cms string,"
        " detected_language string, language_confidence int, author string, author_source string"
    )
    return rows(schema, *pages)


def test_request(rows):
    table = facts(rows, ("u", "t" * 300, None, "b" * 3000, None, "en", 90, "Ann Lee", "meta"), ("v", None, None, None, "Wix", None, None, None, None))
    batches = classify.batch_assign(table, 10)
    payload = classify.request_payload(classify.request_context(batches)).collect()
    assert len(payload) == 1
    first, second = json.loads(payload[0].payload)
    assert list(first) == list(classify.CONTEXT_FIELDS)
    assert (len(first["title"]), first["description"], len(first["body_text"]), first["cms"]) == (200, "", 2500, None)
    assert second["cms"] == "Wix" and second["rule_based_author_hint"] is None


def test_payload_keeps_letters(rows):
    table = facts(rows, ("u", "é😀", None, "", None, None, None, None, None))
    payload = classify.request_payload(classify.request_context(classify.batch_assign(table))).first().payload
    assert "é😀" in payload


@pytest.mark.parametrize("size", [1, 3, 10])
def test_batches(spark, size):
    sites = spark.range(25).select(F.format_string("u%03d", "id").alias("url"))
    out = classify.batch_assign(sites, size, chunks=4).collect()
    assert {r.url: r.batch_id for r in out} == {f"u{i:03}": i // size for i in range(25)}


def test_pages_of_one_url_fill_a_batch(rows):
    sites = rows("page_id bigint, url string", (5, "a"), (9, "b"), (1, "b"), (4, "b"), (None, "c"), (7, "d"))
    out = classify.batch_assign(sites, 2, chunks=3).collect()
    assert {(r.url, r.page_id): r.batch_id for r in out} == {
        ("a", 5): 0, ("b", 1): 0, ("b", 4): 1, ("b", 9): 1, ("c", None): 2, ("d", 7): 2,
    }


def test_batch_size_is_checked(spark):
    for size in (0, 21):
        with pytest.raises(ValueError):
            classify.batch_assign(spark.range(1).withColumnRenamed("id", "url"), size)


def test_scorer(rows):
    out = classify.classify_sites(facts(
        rows,
        ("https://shop.x.org", "Cheap shoes shop", "buy in our store", "cart checkout travel", None, "en", 80, "Ann Lee", "jsonld"),
        ("https://x.org", None, None, "", None, None, None, None, None),
    )).orderBy("url").collect()
    shop, empty = out
    assert (shop.site_type, shop.niche, shop.class_language, shop.class_author) == ("E-commerce", "Travel Blog", "English (en)", "Ann Lee")
    assert tuple(shop.confidence) == (100, 100, 80, 95)
    assert (empty.site_type, empty.niche, tuple(empty.confidence)) == ("Unknown", None, (0, 0, 0, 0))


def test_language(evaluate):
    text = lambda words: (words + " ") * 12
    guess = lambda c: labels.language_guess(c)["label"]
    cases = {
        text("the cat and the dog"): "en", text("der hund und die katze"): "de", text("le chat et les chiens"): "fr",
        text("el gato y los perros"): "es", text("привет мир"): "ru", text("こんにちは世界の人"): "ja",
        "the cat and the dog": None,  # too short
        text("xxxx yyyy"): None, None: None,
    }
    assert evaluate(guess, *cases) == list(cases.values())


# Sentences that are in no sample.
SENTENCES = {
    "en": "Yesterday we walked along the river and talked about nothing in particular.",
    "de": "Gestern gingen wir am Fluss entlang und sprachen über nichts Besonderes.",
    "fr": "Hier nous avons marché le long de la rivière et parlé de tout et de rien.",
    "es": "Ayer caminamos junto al río y hablamos de cosas sin importancia.",
    "it": "Ieri abbiamo camminato lungo il fiume e parlato del più e del meno.",
    "pt": "Ontem caminhamos ao longo do rio e falamos sobre coisas sem importância.",
    "nl": "Gisteren liepen we langs de rivier en praatten we over niets bijzonders.",
    "af": "Gister het ons langs die rivier gestap en oor niks besonders gepraat nie.",
    "sv": "Igår gick vi längs floden och pratade om ingenting särskilt.",
    "da": "I går gik vi langs floden og talte om ikke noget særligt.",
    "no": "I går gikk vi langs elven og snakket om ingenting spesielt.",
    "fi": "Eilen kävelimme joen vartta ja puhuimme kaikenlaisesta.",
    "et": "Eile jalutasime mööda jõe kallast ja rääkisime kõigest.",
    "lv": "Vakar mēs gājām gar upi un runājām par visu ko, kas mums patīk.",
    "lt": "Vakar ėjome palei upę ir kalbėjomės apie viską, kas mums patinka.",
    "pl": "Wczoraj szliśmy wzdłuż rzeki i rozmawialiśmy o niczym szczególnym.",
    "cs": "Včera jsme šli podél řeky a povídali si o ničem zvláštním.",
    "sk": "Včera sme išli popri rieke a rozprávali sme sa o ničom zvláštnom.",
    "sl": "Včeraj smo hodili ob reki in se pogovarjali o ničemer posebnem.",
    "hr": "Jučer smo hodali uz rijeku i razgovarali ni o čemu posebnom.",
    "hu": "Tegnap a folyó mentén sétáltunk, és semmi különösről nem beszélgettünk.",
    "ro": "Ieri am mers de-a lungul râului și am vorbit despre nimic deosebit.",
    "sq": "Dje ecëm përgjatë lumit dhe folëm për asgjë të veçantë.",
    "tr": "Dün nehir boyunca yürüdük ve özel bir şey hakkında konuşmadık.",
    "ca": "Ahir vam caminar al llarg del riu i vam parlar de res en particular.",
    "cy": "Ddoe cerddon ni ar hyd yr afon a siarad am ddim byd arbennig.",
    "id": "Kemarin kami berjalan di sepanjang sungai dan berbicara tentang hal biasa.",
    "tl": "Kahapon ay naglakad kami sa tabi ng ilog at nag-usap tungkol sa kung anu-ano.",
    "sw": "Jana tulitembea kando ya mto na kuzungumza kuhusu mambo ya kawaida.",
    "so": "Shalay waxaan ku soconnay webiga dhinaciisa oo waxaan ka hadalnay waxyaabo caadi ah.",
    "vi": "Hôm qua chúng tôi đi dọc bờ sông và nói chuyện về những điều bình thường.",
    "ru": "Вчера мы гуляли вдоль реки и говорили ни о чём особенном.",
    "uk": "Вчора ми гуляли вздовж річки і розмовляли ні про що особливе.",
    "bg": "Вчера се разхождахме край реката и говорихме за нищо особено.",
    "mk": "Вчера шетавме покрај реката и зборувавме за ништо посебно.",
    "ar": "أمس مشينا على طول النهر وتحدثنا عن أشياء عادية كثيرة حتى المساء.",
    "fa": "دیروز کنار رودخانه قدم زدیم و درباره چیزهای معمولی صحبت کردیم.",
    "ur": "کل ہم دریا کے کنارے چلے اور عام باتوں کے بارے میں بات کی۔",
    "hi": "कल हम नदी के किनारे चले और सामान्य बातों के बारे में बात की।",
    "mr": "काल आम्ही नदीच्या काठाने चाललो आणि साध्या गोष्टींबद्दल बोललो.",
    "ne": "हिजो हामी नदीको किनारमा हिँड्यौं र सामान्य कुराहरूको बारेमा कुरा गर्यौं।",
    "ja": "昨日は川に沿って歩きながら、いろいろなことについてのんびりと話をしました。とても楽しい一日でしたし、天気もよかったです。",
    "ko": "어제 우리는 강을 따라 걸으면서 여러 가지 이야기를 나누었습니다. 날씨가 좋아서 아주 즐거운 하루였다고 생각합니다.",
    "el": "Χθες περπατήσαμε κατά μήκος του ποταμού και μιλήσαμε για διάφορα.",
    "he": "אתמול הלכנו לאורך הנהר ודיברנו על דברים שונים ומשונים כל היום.",
    "th": "เมื่อวานเราเดินเล่นริมแม่น้ำและคุยกันเรื่องทั่วไปตลอดทั้งวันอย่างสนุกสนาน",
    "ta": "நேற்று நாங்கள் ஆற்றங்கரையில் நடந்து பல விஷயங்களைப் பற்றி பேசினோம்.",
}


def test_fifty_languages_can_be_told():
    assert len({c for c, _ in lookups.LANGUAGE_NAMES}) == len(lookups.LANGUAGE_NAMES) >= 50


def test_sentences_of_many_languages(evaluate):
    guess = lambda c: labels.language_guess(c)["label"]
    assert dict(zip(SENTENCES, evaluate(guess, *SENTENCES.values()))) == {c: c for c in SENTENCES}


def test_no_language_where_there_is_no_evidence(evaluate):
    guess = lambda c: labels.language_guess(c)["label"]
    none = [
        "qwrt zxcv plkj hgfd mnbv wrtz pqsd xcvb nmlk jhgf dsaq wert zuio plmk", "1234567890 " * 8, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁᛃ " * 5, "$$$ %%% &&& " * 9,
        # A sentence in Danish and in Norwegian: too close to call.
        "de var en god dag " * 1 + "i det store og hele og alt var som det var da",
    ]
    assert evaluate(guess, *none[:4]) == [None] * 4
    assert evaluate(guess, none[4])[0] in (None, "da", "no")


def test_confidence_grows_with_the_lead(evaluate):
    sure = lambda c: labels.language_guess(c)["confidence"]
    polish, norwegian = evaluate(sure, SENTENCES["pl"], SENTENCES["no"])
    assert 90 < polish <= 100 and 0 < norwegian < 40


def test_scores_are_those_of_the_profiles():
    weights = languages.profiles(tuple(t for _, t in LANGUAGES.values()))
    text = languages.cleaned_sample(SENTENCES["sv"])
    found = languages.runs_of(text)
    sums = [sum(k * weights[r][i] for r, k in found.items() if r in weights) for i in range(len(LANGUAGES))]
    order = sorted(range(len(sums)), key=lambda i: (-sums[i], i))
    known = {r: k for r, k in found.items() if r in weights}
    want = (order[0], sums[order[0]] - sums[order[1]], sum(known.values()), sum(k for r, k in known.items() if len(r) == 3), len(text))
    assert languages.Tables(weights).score(text) == want
    assert languages.Tables(weights).score(" ") is None


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 50")
    hit = docs.select((labels.language_guess(F.col("text"))["label"] == F.col("lang")).alias("hit"))
    assert hit.agg(F.avg(F.coalesce(F.col("hit").cast("int"), F.lit(0)))).first()[0] > 0.9


def test_learned_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    train = docs.join(marks, "doc_id").select("text", F.col("quality").cast("double").alias("label"))
    model = classify.train_classifier(train, features=1 << 10)
    out = model.transform(train)
    assert out.where(F.col("prediction") == F.col("label")).count() > 0.7 * train.count()
