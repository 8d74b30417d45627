"""Column types and the fixed values of the post-classification task."""

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------
LABEL_CODES = {
    "non_damage": 0,
    "damaged_infrastructure": 1,
    "damaged_nature": 2,
    "fires": 3,
    "flood": 4,
    "human_damage": 5,
}
DISPLAY_NAMES = ["ND", "DI", "DN", "Fires", "Flood", "HD"]
MAX_TOKENS = 300
# Cells that a pandas reader takes as missing unless told otherwise.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# ------------------------------------------------------------------------------

MANIFEST = T.StructType(
    [
        T.StructField("image", T.StringType()),
        T.StructField("tweet", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("train_acc", T.DoubleType()),
        T.StructField("valid_loss", T.DoubleType()),
        T.StructField("valid_acc", T.DoubleType()),
    ]
)
