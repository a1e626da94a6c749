"""Column functions on small cases worked out by hand or by plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions import answers, boxes, numbers, prompts, scoring, strings, textscores, windows
from scorelake.functions.draws import SEED, draw, poisson_one


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return df.select(expr.alias("v")).first()["v"]


def many(spark, texts, fn, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_last_numbers(spark):
    texts = ["1e-5", ".25", "0.5-0.7", "100,000", "1.", "", "a -3 b 4.50", "no", "1 2 3"]
    got = many(spark, texts, lambda t: numbers.last_numbers_text(t, 2))
    assert got == ["1,-5", "", "0.5,-0.7", "100,000", "", "", "-3,4.50", "", "2,3"]
    assert many(spark, [".25"], lambda t: numbers.last_numbers_text(t, 1)) == ["25"]


def test_fused_parse_equals_two_steps(spark):
    texts = ["[0.1, 0.2, 0.3, 0.4]", "1 2 3", "x", "9 0.123456789 -2 3. 7"]
    fused = many(spark, texts, lambda t: numbers.last_numbers(t, 4))
    steps = many(spark, texts, lambda t: numbers.parse_prediction(numbers.last_numbers_text(t, 4), 4))
    assert fused == steps
    assert fused[3][0] == pytest.approx(0.123456789, abs=1e-8) and fused[3][0] != 0.123456789


def test_digits_of_any_script(spark):
    texts = ["about ٣.٥ and -１２", "३ १ 7"]
    assert many(spark, texts, lambda t: numbers.last_numbers_text(t, 2)) == ["٣.٥,-１２", "१,7"]
    assert many(spark, texts, lambda t: numbers.last_numbers(t, 2)) == [[3.5, -12], [1, 7]]
    assert many(spark, ["٣.٥,-１２"], lambda t: numbers.parse_prediction(t, 2)) == [[3.5, -12]]


def test_prediction_rejects_what_a_number_is_not(spark):
    texts = ["1,2", " 1 , 2 ", "1,2,3", "1f,2", "a,2", "", "1d,2", "1e3,-.5"]
    got = many(spark, texts, lambda t: numbers.parse_prediction(t, 2))
    assert got == [[1, 2], [1, 2], None, None, None, None, None, [1000, -0.5]]


def test_targets(spark):
    assert many(spark, ["[0.1, 2]", "(3, 4)", "5.5", "[7]"], numbers.parse_target) == [[0.1, 2], [3, 4], [5.5], [7]]
    assert many(spark, ["boom"], lambda t: numbers.parse_target(t, strict=False)) == [None]
    with pytest.raises(Exception, match="not numeric"):
        many(spark, ["boom"], numbers.parse_target)


def test_first_response(spark):
    texts = ['[["a"]]', '[[["b"]]]', "[[]]", '[["[x]"]]']
    assert many(spark, texts, numbers.first_response) == ["a", "b", None, "[x]"]


def test_task_kinds():
    assert [numbers.answer_length(k) for k in ("AD", "TL", "Detection")] == [1, 2, 4]
    with pytest.raises(ValueError):
        numbers.answer_length("other")


BOXES = {
    "same": ([0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0], (1, 1, 1, 1)),
    "half": ([0.0, 0.0, 0.5, 1.0], [0.0, 0.0, 1.0, 1.0], (0.5, 2 / 3, 1, 0.5)),
    "apart": ([0.0, 0.0, 0.1, 0.1], [0.5, 0.5, 0.6, 0.6], (0, 0, 0, 0)),
    "touching": ([0.0, 0.0, 0.5, 0.5], [0.5, 0.0, 1.0, 0.5], (0, 0, 0, 0)),
    "flat": ([0.2, 0.2, 0.2, 0.6], [0.0, 0.0, 1.0, 1.0], (0, 0, 0, 0)),
    "inverted": ([0.8, 0.8, 0.2, 0.2], [0.0, 0.0, 1.0, 1.0], (0, 0, 0, 0)),
    "short": ([0.2, 0.2], [0.0, 0.0, 1.0, 1.0], (None,) * 4),
    "missing": (None, [0.0, 0.0, 1.0, 1.0], (None,) * 4),
}


def test_overlap_by_expression_and_by_steps(spark):
    df = spark.createDataFrame(
        [(n, p, t) for n, (p, t, _) in BOXES.items()], "name string, p array<double>, t array<double>"
    )
    p, t = F.col("p"), F.col("t")
    rows = df.select("name", boxes.iou(p, t), boxes.f1(p, t), boxes.precision(p, t), boxes.recall(p, t)).collect()
    steps = {r["name"]: r for r in scoring.with_scores(df, p, t, "Detection", "null").collect()}
    zero = {r["name"]: r for r in scoring.with_scores(df, p, t, "Detection", "zero").collect()}
    for row in rows:
        want = BOXES[row[0]][2]
        for value, expected, name in zip(row[1:], want, ("iou", "f1", "precision", "recall")):
            assert value == (None if expected is None else pytest.approx(expected)), (row[0], name)
            assert steps[row[0]][name] == (None if expected is None else pytest.approx(expected))
            assert zero[row[0]][name] == pytest.approx(expected or 0)
        failed = want[0] is None
        assert steps[row[0]]["success"] is (not failed)
        assert (steps[row[0]]["mae"] is None) == failed


def test_overlap_properties(spark):
    rng = random.Random(3)

    def box():
        x, y = rng.random() * 0.7, rng.random() * 0.7
        return [x, y, x + 0.01 + rng.random() * 0.29, y + 0.01 + rng.random() * 0.29]

    df = spark.createDataFrame([(box(), box()) for _ in range(400)], "p array<double>, t array<double>")
    for r in scoring.with_scores(df, F.col("p"), F.col("t"), "Detection").collect():
        assert 0 <= r["iou"] <= r["f1"] <= 1 + 1e-12
        if r["precision"] and r["recall"]:
            assert r["f1"] == pytest.approx(2 * r["precision"] * r["recall"] / (r["precision"] + r["recall"]))


def test_relative_errors(spark):
    df = spark.createDataFrame(
        [([2.0], [-4.0]), ([3.0], [2.0]), ([1.0], [0.0]), (None, [1.0])], "p array<double>, t array<double>"
    )
    rows = scoring.with_scores(df, F.col("p"), F.col("t"), "AD").collect()
    assert rows[0]["mre"] == pytest.approx(-1.5) and rows[1]["mre"] == pytest.approx(0.5)
    assert rows[2]["mre"] == pytest.approx(1e15) and rows[3]["mre"] is None and rows[3]["success"] is False
    pair = spark.createDataFrame([([2.0, 4.0], [1.0])], "p array<double>, t array<double>")
    assert scoring.with_scores(pair, F.col("p"), F.col("t"), "TL").first()["mae"] == 2.0


def test_online_scores(spark):
    df = spark.createDataFrame([([-1.0], [2.0]), ([1.0], [2.0])], "p array<double>, t array<double>")
    got = [r["s"] for r in df.select(scoring.online_scores(F.col("p"), F.col("t"), "mask").alias("s")).collect()]
    assert [g["success"] for g in got] == [False, True] and got[1]["re"] == pytest.approx(0.5)
    zero = spark.createDataFrame([([1.0, 1.0], [0.0, 2.0])], "p array<double>, t array<double>")
    lesion = zero.select(scoring.online_scores(F.col("p"), F.col("t"), "lesion").alias("s")).first()["s"]
    assert lesion["mre"] == math.inf and lesion["success"]


def test_ratio_bins(spark):
    values = [0.0, 0.05, 0.1, 0.15, 0.3, 0.899999, 0.9, 2.0]
    got = many(spark, values, boxes.ratio_bin, "double")
    assert got == ["<0.05", "0.05~0.10", "0.10~0.15", "0.15~0.20", "0.30~0.35", "0.85~0.90", ">=0.90", ">=0.90"]
    assert len(boxes.ratio_bin_names("percent")) == 19


def test_box_target_turns_the_image_over(spark):
    expr = boxes.box_target(F.array(F.lit(10.0), F.lit(20.0)), F.array(F.lit(30.0), F.lit(60.0)), F.array(F.lit(100), F.lit(200)))
    assert one(spark, expr) == pytest.approx([0.1, 0.7, 0.3, 0.9])


def test_fixed_decimals_equal_python_format(spark):
    rng = random.Random(5)
    values = [0.5515, 0.0005, 2.675, 1.005, -0.00049, -1.5, 0.125, 1e6 + 0.0005, 0.9995, 12.0, 0.0]
    values += [rng.uniform(-50, 50) for _ in range(500)] + [round(rng.uniform(0, 9), 4) for _ in range(500)]
    for digits in (2, 3, 4):
        got = many(spark, values, lambda v: strings.fixed_decimals(v, digits), "double")
        assert got == [f"{v:.{digits}f}" for v in values]


def test_names_and_flags(spark):
    assert many(spark, ["a/b/c:d", "x", "org/m?"], strings.sanitize_model_name) == ["b/c__d".replace("/", "__"), "x", "org__m__"]
    assert many(spark, ["é-1 b"], strings.sanitize_task_name) == ["é_1_b"]
    assert many(spark, ["samples_a_b_2024.jsonl"], strings.run_task) == ["a_b"]
    assert many(spark, ["samples_a_b_2024.jsonl"], strings.run_time) == ["2024"]
    assert many(spark, ["Yes", "0", "T"], strings.to_boolean) == [True, False, True]
    with pytest.raises(Exception, match="not a boolean"):
        many(spark, ["maybe"], strings.to_boolean)
    texts = ['{"a":1}', '{"a":1}}', "", "1,2", "[1]", '"x"', "1,\"a\":2", "nul"]
    assert many(spark, texts, strings.is_json) == [True, False, False, False, True, True, False, False]
    assert many(spark, ["do n't ( x ) \" y \" , z ."], strings.detokenize) == ["don't (x)\"y\", z."]


def test_regex_filter(spark):
    texts = ["#### 1,200 and #### 7", "none", "#### -3."]
    assert many(spark, texts, answers.regex_text) == ["1,200", "[invalid]", "-3."]
    assert many(spark, texts, lambda t: answers.regex_text(t, group_select=-1)) == ["7", "[invalid]", "-3."]
    assert many(spark, ["ab=1", "cd:2"], lambda t: answers.regex_text(t, r"(\w)=(\d)|(\w):(\d)")) == ["b", "d"]


def test_multi_choice_filter(spark):
    choices = F.array(F.lit("red"), F.lit("dark red"), F.lit("blue"))
    texts = ["it is (C)", "DARK RED it is", "answer: B", "whatever", "blue or red"]
    got = many(spark, texts, lambda t: answers.multi_choice_text(t, choices, r"(\([A-Z]\))", ignore_case=True))
    assert got == ["(C)", "(B)", "(B)", "[invalid]", "(C)"]
    question = F.lit("Pick.\nA. cat\nB. dog (big)\nC. cow")
    got = many(spark, ["The cow!", "a bird?"], lambda t: answers.simple_choice_text(t, question))
    assert got == ["C", "a bird"]


def test_reasoning_answers(spark):
    texts = ["<think>x</think><answer> 4\n</answer>", r"so \boxed{ 7 }", "plain", r"<answer>1</answer> \boxed{2}"]
    assert many(spark, texts, answers.reasoning_answer_text) == ["4", "7", "plain", "1"]


def vqa(text):
    """The normaliser written out step by step."""
    t = text.lower().replace(",", "").replace("?", "").replace("'s", " 's").strip()
    t = t.replace("\n", " ").replace("\t", " ").strip()
    out = t
    for mark in answers.PUNCTUATION:
        out = out.replace(mark, "" if f"{mark} " in t or f" {mark}" in t else " ")
    chars, kept = [], 0
    for i, c in enumerate(out):
        if c == "." and not out[i + 1 : i + 2].isdigit() and kept < answers.MAX_PERIODS:
            kept += 1
            continue
        chars.append(c)
    words = [answers.NUMBER_WORDS.get(w, w) for w in "".join(chars).split()]
    return " ".join(answers.CONTRACTIONS.get(w, w) for w in words if w not in answers.ARTICLES)


def test_vqa_answers(spark):
    texts = ["The two dogs!", "A cat-dog; dont", "It's 3.5 m.", "one, two? three", "x/y a / b", "." * 40 + " end", "", "youre\there"]
    assert many(spark, texts, answers.vqa_answer_text) == [vqa(t) for t in texts]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_anls(spark):
    cases = [(["Hello  World", "x"], "hello world"), (["abc"], "abd"), (["abcd"], "zzzz"), ([""], ""), (["été"], "ete")]
    df = spark.createDataFrame(cases, "r array<string>, p string")
    got = [r[0] for r in df.select(textscores.anls(F.col("r"), F.col("p"))).collect()]
    tidy = lambda s: " ".join(s.strip().lower().split())
    for (refs, pred), value in zip(cases, got):
        low = min(edit(tidy(r), tidy(pred)) / max(len(r), len(pred)) if max(len(r), len(pred)) else 0 for r in refs)
        assert value == pytest.approx(1 - low if 1 - low >= 0.5 else 0)


def test_choice_scores(spark):
    df = spark.createDataFrame([([3.0, 1.0, 1.0], ["aaaa", "b", "cc"], 1, [False, True, False])], "l array<double>, c array<string>, g int, y array<boolean>")
    gold = textscores.gold_index(F.col("g"), F.col("c"))
    s = df.select(textscores.choice_scores(F.col("l"), F.col("c"), gold, F.col("y")).alias("s")).first()["s"]
    assert (s["pred"], s["pred_norm"], s["acc"], s["acc_norm"], s["exact_match"]) == (1, 2, 1.0, 0.0, 1)
    out = df.select(textscores.gold_index(F.lit(7), F.col("c")), textscores.gold_index(F.lit("cc"), F.col("c"), "text")).first()
    assert tuple(out) == (-100, 2)


def windows_of(tokens, prefix, longest, context):
    out, stride = [], longest - context + 1
    if not tokens:
        return out
    head = min(longest, len(tokens))
    out.append(([prefix, *tokens[: head - 1]], tokens[:head]))
    done = head
    while done < len(tokens):
        size = min(stride, len(tokens) - done)
        end = done + size
        out.append((tokens[end - longest - 1 : end - 1], tokens[end - size : end]))
        done = end
    return out


@pytest.mark.parametrize("longest,context", [(4, 1), (4, 4), (5, 3), (3, 2)])
def test_rolling_windows(spark, longest, context):
    lists = [[str(i) for i in range(n)] for n in (0, 1, 3, 4, 5, 9, 12, 13)]
    got = many(spark, lists, lambda t: windows.rolling_windows(t, F.lit("<s>"), longest, context), "array<string>")
    for tokens, found in zip(lists, got):
        assert [(w["input"], w["predicted"]) for w in found] == windows_of(tokens, "<s>", longest, context)


def test_prompts(spark):
    spacing = F.array(F.lit(0.5), F.lit(0.25))
    text = one(spark, prompts.lesion_prompt(F.lit("a CT"), F.lit("liver tumor"), prompts.unit_name(F.lit("mm")), spacing))
    assert "in millimeters.\n" in text and "0.250 millimeters (width) x 0.500 millimeters (height)." in text
    assert one(spark, prompts.unit_from_list(F.array(F.lit("mm")))) == "mm"
    text = one(spark, prompts.distance_task(F.lit(""), F.array(F.lit("P"), F.lit("Q")), F.lit("mm ")))
    assert text == "estimate the distance between 2 landmark points in millimeters: (landmark 1) P, (landmark 2) Q.\n"
    mask = one(spark, prompts.mask_prompt(F.lit("a CT"), F.lit("liver"), spacing))
    assert "0.250 (width) x 0.500 (height)." in mask
    assert one(spark, prompts.to_grey_levels(F.array(F.lit(1.0), F.lit(2.0), F.lit(1.999)))) == [0, 255, 254]
    assert one(spark, prompts.to_grey_levels(F.array(F.lit(4.0), F.lit(4.0)))) == [0, 0]
    with pytest.raises(Exception, match="slice_dim"):
        one(spark, prompts.pixel_spacing(F.lit(3), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))))
    names = ["Alpha Beta", "Gamma"]
    got = many(spark, ["x alpha BETA y", "gamma, alpha beta", "", None, "zzz"], lambda t: prompts.subtask_name(t, names))
    assert got == ["Alpha Beta", "Alpha Beta", "Not Specified", "Not Specified", "Further Insights"]


def py_draw(key, stream, seed=SEED):
    mask = 0xFFFFFFFF

    def mix(x):
        for _ in range(2):
            x = ((x >> 16 ^ x) * 0x45D9F3B) & mask
        return x >> 16 ^ x

    return mix((mix(((key ^ key >> 32) & mask) ^ seed) + stream * 40503) & mask)


def test_draws(spark):
    df = spark.createDataFrame([(k, s) for k in (0, 1, 7, 10**12) for s in (0, 3)], "k bigint, s int")
    for r in df.withColumn("d", draw(F.col("k"), F.col("s"))).collect():
        assert r["d"] == py_draw(r["k"], r["s"])


def test_poisson_weights_have_mean_and_variance_one(spark):
    df = spark.range(40000).withColumn("w", poisson_one(draw(F.col("id")) / float(1 << 32)))
    r = df.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert r["m"] == pytest.approx(1, abs=0.03) and r["v"] == pytest.approx(1, abs=0.05)


def test_blanks_of_unicode(spark):
    from scorelake.functions import answers, textscores
    from scorelake.functions.numbers import strip

    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    df = spark.createDataFrame([(f"{b}yes{b}{b}no{b}",) for b in blanks], "t string")
    rows = df.select("t", strip(F.col("t")).alias("s"), textscores.collapsed(F.col("t")).alias("c"), answers.plain_words_text(F.col("t")).alias("w")).collect()
    assert all((r.s, r.c, r.w) == (r.t.strip(), "yes no", "yes no") for r in rows)
    article = spark.createDataFrame([("a\xa0dog\u2003runs",)], "t string").select(answers.vqa_answer_text(F.col("t")).alias("v")).first()
    assert article.v == "dog runs"


def test_a_missing_ratio_has_no_bin(spark):
    from scorelake.functions.boxes import ratio_bin

    rows = spark.createDataFrame([(None,), (0.95,), (0.01,)], "r double").select(ratio_bin(F.col("r")).alias("b")).collect()
    assert [r.b for r in rows] == [None, ">=0.90", "<0.05"]
