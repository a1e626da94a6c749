"""Label tables: the anatomy class of a label and the name it is reported under."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Anatomy class -> labels.
_TOOTH_PLACES = [
    "canine", "central incisor", "lateral incisor", "first premolar", "second premolar", "first molar",
    "second molar", "third molar (wisdom tooth)",
]
CLASSES: dict[str, list[str]] = {
    "Artery": [
        "aorta", "anterior communicating artery", "basilar artery", "left iliac artery",
        "left anterior cerebral artery", "left common carotid artery", "left internal carotid artery",
        "left middle cerebral artery", "left posterior cerebral artery",
        "left posterior communicating artery", "left subclavian artery", "renal artery",
        "right iliac artery", "right anterior cerebral artery", "right common carotid artery",
        "right internal carotid artery", "right middle cerebral artery", "right posterior cerebral artery",
        "right posterior communicating artery", "right subclavian artery", "third a2 segment",
        "brachiocephalic trunk",
    ],
    "Vein": [
        "superior vena cava", "inferior vena cava", "inferior vena cava (ivc)", "postcava",
        "postcava (inferior vena cava)", "portal and splenic veins", "portal vein and splenic vein",
        "left brachiocephalic vein", "right brachiocephalic vein", "left iliac vein", "right iliac vein",
        "renal vein",
    ],
    "Brain": [
        "brain", "skull", "anterior hippocampus", "posterior hippocampus", "deep grey matter",
        "grey matter", "white matter", "brainstem", "cerebellum", "ventricles",
        "external cerebrospinal fluid",
    ],
    "Brain Tumor/Lesion": [
        "stroke infarct", "peritumoral edema of brain", "edema of brain",
        "surrounding non-enhancing flair hyperintensity of brain", "resection cavity of brain",
        "enhancing brain tumor", "enhancing brain tumor tissue", "non-enhancing brain tumor",
        "non-enhancing brain tumor core", "gross tumor volume of brain", "cystic component of brain",
    ],
    "Heart": [
        "heart", "left atrium", "left atrium of heart", "left atrial appendage", "left ventricular cavity",
        "left ventricular myocardium", "left ventricle", "right ventricular cavity", "myocardium",
    ],
    "Lung": [
        "left lung", "left lung lower lobe", "left lung upper lobe", "right lung", "right lung lower lobe",
        "right lung middle lobe", "right lung upper lobe",
    ],
    "Lung Tumor/Lesion": ["lung cancer"],
    "Liver": ["liver", "liver vessel"],
    "Liver Tumor/Lesion": ["liver cancer", "liver tumour", "liver tumor"],
    "Kidney": ["kidney", "right kidney", "left kidney"],
    "Kidney Tumor/Lesion": ["kidney cyst", "left kidney cyst", "right kidney cyst", "kidney tumor"],
    "Pancreas": ["pancreas"],
    "Pancreas Tumor/Lesion": ["pancreas cancer"],
    "Gallbladder": ["gall bladder", "gallbladder"],
    "Spleen": ["spleen"],
    "Adrenal Gland": [
        "adrenal gland", "left adrenal gland", "left adrenal gland (lag)", "right adrenal gland",
        "right adrenal gland (rag)",
    ],
    "Colon": ["colon"],
    "Colon Tumor/Lesion": ["colon cancer primaries"],
    "Intestine": ["rectum", "duodenum", "small bowel"],
    "Esophagus": ["esophagus"],
    "Stomach": ["stomach"],
    "Urinary System": ["urinary bladder", "bladder"],
    "Uterus": ["uterus"],
    "Prostate": ["prostate", "peripheral zone of prostate", "transition zone of prostate"],
    "Head-Neck": ["cochlea", "trachea", "pharynx", "thyroid gland"],
    "Head-Neck Tumor/Lesion": ["primary gross tumor volume (head & neck)", "vestibular schwannoma"],
    "Hip": [
        "left hip", "right hip", "sacrum", "left gluteus maximus", "left gluteus medius",
        "left gluteus minimus", "right gluteus maximus", "right gluteus medius", "right gluteus minimus",
        "right iliopsoas", "left iliopsoas",
    ],
    "Rib": [
        *[f"{s} {n} rib" for s in ("left", "right") for n in ("1st", "2nd", "3rd")],
        *[f"{s} {n}th rib" for s in ("left", "right") for n in range(4, 13)],
        "costal cartilages",
    ],
    "Spine": [
        *[f"vertebra C{n}" for n in range(1, 8)],
        *[f"vertebra T{n}" for n in range(1, 13)],
        *[f"vertebra L{n}" for n in range(1, 6)],
        "vertebra S1", "vertebrae", "intervertebral discs", "spinal cord",
    ],
    "Knee": [
        "femur", "tibia", "left femur", "right femur", "femoral cartilage", "lateral tibial cartilage",
        "medial tibial cartilage", "patellar cartilage", "lateral meniscus", "medial meniscus",
    ],
    "Metastatic Lymph Node": ["metastatic lymph node"],
    "Miscellaneous Tumor/Lesion": ["edema", "tumor", "cystic component"],
    "Jawbone": [
        "upper jawbone", "lower jawbone", "left inferior alveolar canal", "right inferior alveolar canal",
    ],
    "Tooth": [
        f"{jaw} {side} {place}"
        for jaw in ("upper", "lower") for side in ("left", "right") for place in _TOOTH_PLACES
    ],
    "Others": [
        "na", "implant", "crown", "bridge", "left autochthon", "right autochthon", "sternum", "humerus",
        "left humerus", "right humerus", "left clavicle", "right clavicle", "left scapula", "right scapula",
        "prostate/uterus",
    ],
}
# Labels reported under another name; every other label keeps its own.
RENAMED: dict[str, str] = {
    "inferior vena cava (ivc)": "inferior vena cava",
    "postcava (inferior vena cava)": "postcava",
    "portal vein and splenic vein": "portal and splenic vein",
    "anterior hippocampus": "hippocampus",
    "posterior hippocampus": "hippocampus",
    "deep grey matter": "grey matter",
    "external cerebrospinal fluid": "cerebrospinal fluid",
    "peritumoral edema of brain": "brain edema",
    "edema of brain": "brain edema",
    "surrounding non-enhancing flair hyperintensity of brain": "non-enhancing flair hyperintensity of brain",
    "resection cavity of brain": "brain resection cavity",
    "enhancing brain tumor tissue": "enhancing brain tumor",
    "gross tumor volume of brain": "brain tumor",
    "cystic component of brain": "brain cyst",
    "left atrium of heart": "left atrium",
    "liver cancer": "liver tumor",
    "liver tumour": "liver tumor",
    "gall bladder": "gallbladder",
    "left adrenal gland (lag)": "left adrenal gland",
    "right adrenal gland (rag)": "right adrenal gland",
    "colon cancer primaries": "colon cancer",
    "peripheral zone of prostate": "prostate",
    "transition zone of prostate": "prostate",
    "primary gross tumor volume (head & neck)": "head & neck tumor",
    "edema": "miscellaneous tumor/lesion",
    "tumor": "miscellaneous tumor/lesion",
    "cystic component": "miscellaneous tumor/lesion",
    "na": "others",
    "implant": "others",
    "crown": "others",
    "bridge": "others",
}


def label_rows() -> list[tuple[str, str, str]]:
    """(label, class, reported name), one row per label."""
    return [(label, cls, RENAMED.get(label, label)) for cls, labels in CLASSES.items() for label in labels]


def inline_sql() -> str:
    """The label table as an inline SQL table: idx, label_name, anatomy, reported."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rows = ", ".join(
        f"({i}, {text(label)}, {text(cls)}, {text(name)})" for i, (label, cls, name) in enumerate(label_rows())
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(idx, label_name, anatomy, reported)"


def label_table(spark: SparkSession) -> DataFrame:
    """The two label maps as one table. Its size is fixed, so it may be broadcast."""
    return spark.sql(inline_sql()).drop("idx")
