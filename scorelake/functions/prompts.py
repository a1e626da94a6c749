"""Prompt and chat-message columns of training and evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.strings import fixed_decimals

# Wording of the prompts.
ANSWER_BOX = (
    "The answer should be four decimal numbers separated by commas without any units or additional text. "
    "The first two numbers are the coordinates of the lower-left corner and the last two numbers are the "
    "coordinates of the upper-right corner of the bounding box. "
    "Use relative coordinates in the image space, where the origin is at the lower-left corner of the image. "
    "Relative coordinates should be values between 0 and 1, representing the relative positions in the image."
)
ANSWER_BOX_TRAINING = (
    "Return the coordinates as [x1, y1, x2, y2] where (x1, y1) is the lower-left corner and (x2, y2) is the "
    "upper-right corner, with coordinates normalized to [0, 1]."
)
ANSWER_MASK = "The answer should be 1 decimal number without any units or additional text."
ANSWER_LESION = (
    "The answer should be two decimal numbers separated by a comma without any units or additional text. "
    "The first is the major axis length, and the second is the minor axis length."
)
ANSWER_BIOMETRIC = "The answer should be a single decimal number without any units or additional text."
REASONING = (
    "First thinks about the reasoning process in the mind and then provides the final answer. "
    "The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, "
    "respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>. "
)
ANSWER_BOX_REASONING = REASONING + ANSWER_BOX
ANSWER_LESION_REASONING = REASONING + ANSWER_LESION

# Image side (height = width) of models that resize every image alike.
FIXED_INPUT_SIDE = {
    "gemma3": 896, "medgemma": 896, "meddr": 448, "internvl3": 448, "llava_med": 336,
    "huatuogpt_vision": 336, "healthgpt_l14": 336,
}
# Models whose input shape depends on the image and has to come as a column.
DYNAMIC_INPUT_MODELS = ("qwen2_5_vl", "lingshu", "llama_3_2_vision", "llava_onevision")
# Units spelled out in prompts.
UNIT_NAMES = {"mm": "millimeters", "cm": "centimeters"}


def model_input_shape(model: Column, dynamic_shape: Column | None = None) -> Column:
    """(height, width) an image is resized to before the model sees it."""
    shape = F.when(F.lit(False), F.array(F.lit(0), F.lit(0)))
    for name, side in FIXED_INPUT_SIDE.items():
        shape = shape.when(model == name, F.array(F.lit(side), F.lit(side)))
    if dynamic_shape is not None:
        shape = shape.when(model.isin(*DYNAMIC_INPUT_MODELS), dynamic_shape)
    unknown = F.raise_error(F.concat(F.lit("no input shape known for model "), model))
    return shape.otherwise(unknown.cast("array<int>"))


def pixel_spacing(slice_dim: Column, voxel_size: Column) -> Column:
    """(height, width) spacing of the slice taken across one axis of a volume."""
    z = [F.get(voxel_size, F.lit(i)) for i in range(3)]
    return (
        F.when(slice_dim == 0, F.array(z[1], z[2]))
        .when(slice_dim == 1, F.array(z[0], z[2]))
        .when(slice_dim == 2, F.array(z[0], z[1]))
        .otherwise(F.raise_error(F.lit("slice_dim must be 0, 1 or 2")).cast("array<double>"))
    )


def resized_spacing(spacing: Column, image_size: Column, resized: Column) -> Column:
    """Spacing after the image was resized, per axis."""
    def axis(i: int) -> Column:
        at = F.lit(i)
        return F.get(spacing, at) / (F.get(resized, at).cast("double") / F.get(image_size, at))

    return F.array(axis(0), axis(1))


def to_grey_levels(pixels: Column) -> Column:
    """Min-max scaling to whole levels 0..255, cut off, not rounded; a flat image is all zero."""
    low, high = F.array_min(pixels), F.array_max(pixels)
    return F.transform(
        pixels,
        lambda x: F.when(high > low, F.floor((x - low) / (high - low) * 255)).otherwise(F.lit(0)).cast("int"),
    )


def unit_name(unit: Column) -> Column:
    """Spell out a unit given as plain text."""
    out = unit
    for short, long in UNIT_NAMES.items():
        out = F.when(unit == short, F.lit(long)).otherwise(out)
    return out


def unit_from_list(units: Column) -> Column:
    """A unit given as a one-element list is used as it stands."""
    return F.when(F.size(units) == 1, F.get(units, F.lit(0))).otherwise(
        F.raise_error(F.lit("a unit list must hold one unit"))
    )


# The wording inside the functions from here to the angle task.
def spacing_text(spacing: Column, unit: Column | None) -> Column:
    suffix = F.lit("") if unit is None else F.concat(F.lit(" "), unit)
    return F.concat(
        F.lit("The pixel size for this image is "),
        fixed_decimals(F.get(spacing, F.lit(1)), 3), suffix, F.lit(" (width) x "),
        fixed_decimals(F.get(spacing, F.lit(0)), 3), suffix, F.lit(" (height)."),
    )


def _question(image: Column, task: Column, extra: Column | None, answer: str) -> Column:
    pieces = [F.lit("Task:\nGiven the input medical image: "), image, F.lit(", "), task]
    if extra is not None:
        pieces += [F.lit("Additional information:\n"), extra, F.lit("\n")]
    return F.concat(*pieces, F.lit("Format requirement:\n" + answer))


def box_prompt(image: Column, label: Column, answer: str = ANSWER_BOX) -> Column:
    task = F.concat(
        F.lit("return the coordinates of the lower-left and upper-right corner of the bounding box for the "),
        label, F.lit(".\n"),
    )
    return _question(image, task, None, answer)


def lesion_prompt(image: Column, label: Column, unit: Column, spacing: Column) -> Column:
    task = F.concat(
        F.lit("estimate the major and minor axis lengths of the ellipse enclosing the "), label,
        F.lit(", in "), unit, F.lit(".\n"),
    )
    return _question(image, task, spacing_text(spacing, unit), ANSWER_LESION)


def mask_prompt(image: Column, label: Column, spacing: Column) -> Column:
    task = F.concat(F.lit("estimate the physical size of the "), label, F.lit(".\n"))
    return _question(image, task, spacing_text(spacing, None), ANSWER_MASK)


def distance_task(name: Column, points: Column, unit: Column) -> Column:
    unit = F.replace(F.trim(unit), F.lit("mm"), F.lit("millimeters"))
    ends = F.concat(
        F.lit("(landmark 1) "), F.get(points, F.lit(0)), F.lit(", (landmark 2) "), F.get(points, F.lit(1)),
        F.lit(".\n"),
    )
    named = F.concat(
        F.lit("estimate the distance of "), name, F.lit(" in "), unit,
        F.lit(", which is the distance between 2 landmark points: "), ends,
    )
    bare = F.concat(F.lit("estimate the distance between 2 landmark points in "), unit, F.lit(": "), ends)
    return F.when(F.coalesce(name, F.lit("")) != "", named).otherwise(bare)


def angle_task(name: Column, points: Column, unit: Column) -> Column:
    """``points`` holds the four landmark names, two per line."""
    p = [F.get(points, F.lit(i)) for i in range(4)]
    lines = F.concat(
        F.lit("(line 1) the line connecting "), p[0], F.lit(" and "), p[1],
        F.lit(", (line 2) the line connecting "), p[2], F.lit(" and "), p[3], F.lit(".\n"),
    )
    named = F.concat(
        F.lit("estimate the angle of "), name, F.lit(" in "), unit,
        F.lit(", which is the angle between 2 lines: "), lines,
    )
    bare = F.concat(F.lit("estimate the angle between 2 lines in "), unit, F.lit(": "), lines)
    return F.when(F.coalesce(name, F.lit("")) != "", named).otherwise(bare)


def biometric_prompt(
    image: Column, metric_type: Column, name: Column, points: Column, unit: Column, spacing: Column
) -> Column:
    task = (
        F.when(metric_type == "distance", distance_task(name, points, unit))
        .when(metric_type == "angle", angle_task(name, points, unit))
        .otherwise(F.raise_error(F.lit("metric type must be distance or angle")))
    )
    return _question(image, task, spacing_text(spacing, F.lit("mm")), ANSWER_BIOMETRIC)


def numbers_answer(values: Column, k: int) -> Column:
    """Three decimals each, joined by a comma and a blank."""
    return F.concat_ws(", ", *[fixed_decimals(F.get(values, F.lit(i)), 3) for i in range(k)])


def chat_messages(prompt: Column, answer: Column) -> Column:
    """User message with an image and a text, then the assistant's text."""
    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))

    user = F.array(part("image", F.lit(None)), part("text", prompt))
    reply = F.array(part("text", answer))
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), reply.alias("content")),
    )


def subtask_name(raw: Column, names: list[str], other: str = "Further Insights") -> Column:
    """First listed name contained in the text, whatever the case; ``other`` if none, and
    ``Not Specified`` for empty text."""
    chosen = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("Not Specified"))
    for name in names:
        chosen = chosen.when(F.contains(F.lower(raw), F.lit(name.lower())), F.lit(name))
    return chosen.otherwise(F.lit(other))
