"""Codes of languages by name, one table for each corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes of the benchmark of two hundred languages, as far as it is used.
FLORES = {
    "Amharic": "amh_Ethi", "Arabic": "arb_Arab", "Assamese": "asm_Beng", "Bambara": "bam_Latn", "Bashkir": "bak_Cyrl", "Basque": "eus_Latn",
    "Belarusian": "bel_Cyrl", "Bemba": "bem_Latn", "Bengali": "ben_Beng", "Bulgarian": "bul_Cyrl", "Burmese": "mya_Mymr", "Cebuano": "ceb_Latn",
    "Chinese": "zho_Hans", "Croatian": "hrv_Latn", "Czech": "ces_Latn", "Danish": "dan_Latn", "Dzongkha": "dzo_Tibt", "English": "eng_Latn",
    "Esperanto": "epo_Latn", "Estonian": "est_Latn", "Ewe": "ewe_Latn", "Faroese": "fao_Latn", "Fijian": "fij_Latn", "Fon": "fon_Latn",
    "French": "fra_Latn", "German": "deu_Latn", "Greek": "ell_Grek", "Gujarati": "guj_Gujr", "Hausa": "hau_Latn", "Hebrew": "heb_Hebr",
    "Hindi": "hin_Deva", "Hungarian": "hun_Latn", "Icelandic": "isl_Latn", "Igbo": "ibo_Latn", "Indonesian": "ind_Latn", "Irish": "gle_Latn",
    "Japanese": "jpn_Jpan", "Javanese": "jav_Latn", "Kannada": "kan_Knda", "Khmer": "khm_Khmr", "Kinyarwanda": "kin_Latn", "Kyrgyz": "kir_Cyrl",
    "Korean": "kor_Hang", "Lao": "lao_Laoo", "Lingala": "lin_Latn", "Ganda": "lug_Latn", "Luganda": "lug_Latn", "Luxembourgish": "ltz_Latn",
    "Malagasy": "plt_Latn", "Malayalam": "mal_Mlym", "Maori": "mri_Latn", "Marathi": "mar_Deva", "Meitei": "mni_Beng", "Nepali": "npi_Deva",
    "Norwegian": "nob_Latn", "Occitan": "oci_Latn", "Oromo": "gaz_Latn", "Portuguese": "por_Latn", "Romanian": "ron_Latn", "Rundi": "run_Latn",
    "Russian": "rus_Cyrl", "Samoan": "smo_Latn", "Sanskrit": "san_Deva", "Shona": "sna_Latn", "Sindhi": "snd_Arab", "Sinhala": "sin_Sinh",
    "Somali": "som_Latn", "Spanish": "spa_Latn", "Sundanese": "sun_Latn", "Swahili": "swh_Latn", "Swati": "ssw_Latn", "Swedish": "swe_Latn",
    "Tajik": "tgk_Cyrl", "Tamil": "tam_Taml", "Tatar": "tat_Cyrl", "Telugu": "tel_Telu", "Tigrinya": "tir_Ethi", "Tsonga": "tso_Latn",
    "Tumbuka": "tum_Latn", "Turkish": "tur_Latn", "Turkmen": "tuk_Latn", "Tswana": "tsn_Latn", "Twi": "twi_Latn", "Ukrainian": "ukr_Cyrl",
    "Umbundu": "umb_Latn", "Urdu": "urd_Arab", "Uyghur": "uig_Arab", "Uzbek": "uzn_Latn", "Vietnamese": "vie_Latn", "Welsh": "cym_Latn",
    "Wolof": "wol_Latn", "Xhosa": "xho_Latn", "Yoruba": "yor_Latn", "Zulu": "zul_Latn", "Asturian": "ast_Latn", "Bhojpuri": "bho_Deva",
    "Guarani": "grn_Latn", "Waray": "war_Latn", "N'ko": "nqo_Nkoo", "Emakhuwa": "vmw_Latn",
}

# Codes of the news test sets.
NTREX = {
    "Amharic": "amh_Ethi", "Azerbaidjani": "aze_Latn", "Belarusian": "bel_Cyrl", "Bashkir": "bak_Cyrl", "Basque": "eus_Latn", "Bemba": "bem_Latn",
    "Bengali": "ben_Beng", "Bulgarian": "bul_Cyrl", "Burmese": "mya_Mymr", "Catalan": "cat_Latn", "Danish": "dan_Latn", "Dhivehi": "div_Thaa",
    "Dzongkha": "dzo_Tibt", "English": "eng_Latn", "Estonian": "est_Latn", "Faroese": "fao_Latn", "Ewe": "ewe_Latn", "Fijian": "fij_Latn",
    "French": "fra_Latn", "Igbo": "ibo_Latn", "Irish": "gle_Latn", "Gujarati": "guj_Gujr", "Hausa": "hau_Latn", "Hindi": "hin_Deva",
    "Japanese": "jpn_Jpan", "Kannada": "kan_Knda", "Khmer": "khm_Khmr", "Kinyarwanda": "kin_Latn", "Kyrgyz": "kir_Cyrl", "Lao": "lao_Laoo",
    "Malagasy": "mlg_Latn", "Malay": "msa_Latn", "Malayalam": "mal_Mlym", "Maori": "mri_Latn", "Marathi": "mar_Deva", "Nepali": "nep_Deva",
    "Oromo": "orm_Ethi", "Samoan": "smo_Latn", "Shona": "sna_Latn", "Sinhala": "sin_Sinh", "Somali": "som_Latn", "Swahili": "swa_Latn",
    "Swati": "ssw_Latn", "Tajik": "tgk_Cyrl", "Tamil": "tam_Taml", "Telugu": "tel_Telu", "Tigrinya": "tir_Ethi", "Turkmen": "tuk_Latn",
    "Tswana": "tsn_Latn", "Uyghur": "uig_Arab", "Urdu": "urd_Arab", "Uzbek": "uzb_Latn", "Wolof": "wol_Latn", "Xhosa": "xho_Latn",
    "Yoruba": "yor_Latn", "Zulu": "zul_Latn",
}

# Codes of the health corpus.
TICO = {
    "Amharic": "am", "Arabic": "ar", "Bengali": "bn", "Kurdish Sorani": "ckb", "Latin American Spanish": "es-LA", "Farsi": "fa", "French": "fr",
    "Nigerian fufulde": "fuv", "Hausa": "ha", "Hindi": "hi", "Indonesian": "id", "Kurdish Kurmanji": "ku", "Lingala": "ln", "Luganda": "lg",
    "Marathi": "mr", "Malay": "ms", "Muanmar": "my", "Nepali": "ne", "Oromo": "om", "Dari": "prs", "Pashto": "ps", "Brazilian Portuguese": "pt-BR",
    "Russian": "ru", "Kinyarwanda": "rw", "Somali": "so", "Swahili": "sw", "Ethiopian Tigrinya": "ti", "Tagalog": "tl", "Urdu": "ur",
    "Chinese (Simplified)": "zh", "Zulu": "zu", "Dinka": "din", "Khmer": "km", "Kanuri": "kr", "Tamil": "ta", "English": "en",
}

# Codes of the reading-comprehension contexts.
XQUAD = {
    "Arabic": "ar", "English": "en", "Chinese": "zh", "German": "de", "Greek": "el", "Hindi": "hi", "Romanian": "ro", "Russian": "ru",
    "Spanish": "es", "Thai": "th", "Turkish": "tr", "Vietnamese": "vi",
}

# Codes of the sentence pairs.
SMOL = {
    "Hausa": "ha", "Igbo": "ig", "Kinyarwanda": "rw", "Somali": "so", "Swahili": "sw", "Xhosa": "xh",
}

BY_CORPUS = {"flores": FLORES, "ntrex": NTREX, "tico": TICO, "xquad": XQUAD, "smol": SMOL}


def code(corpus: str, language: str) -> str:
    """The code of a language in a corpus; a KeyError for one that the corpus does not have."""
    return BY_CORPUS[corpus][language]


def code_table(spark) -> DataFrame:
    """corpus, language, code of all tables: a dimension table to join with."""
    rows = [(c, n, k) for c, t in BY_CORPUS.items() for n, k in t.items()]
    return spark.createDataFrame(rows, "corpus string, language string, code string")


def with_codes(df: DataFrame, corpus: str, language: str = "language") -> DataFrame:
    """Add code of the corpus; null for names that it does not have."""
    known = code_table(df.sparkSession).where(F.col("corpus") == corpus).select(F.col("language").alias("_name"), "code")
    return df.join(F.broadcast(known), F.col(language) == F.col("_name"), "left").drop("_name")  # a fixed table
