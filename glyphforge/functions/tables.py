"""Character tables.  Fixed values, stated as text; nothing here is computed from data."""

# Look-alike characters folded on chart keys and on text.
CONFUSABLES = {"ε": "ɛ", "ι": "ɩ", "ɡ": "g", "ı": "i", "’": "'", "ʼ": "'", "ↄ": "ɔ", "ɂ": "ʔ"}

# Tone and accent marks that sound output never holds.
ACCENTS = "̀́̂̄̉̋̌̏̑"

# Affricate ligatures and pairs, in the order in which they are tied.
LIGATURES = {"ʧ": "t͡ʃ", "ʤ": "d͡ʒ", "ʨ": "t͡ɕ", "ʥ": "d͡ʑ", "ʦ": "t͡s", "ʣ": "d͡z"}
PAIRS = ("tʃ", "dʒ", "tɕ", "dʑ", "ts", "dz", "tʂ", "dʐ", "kp", "ɡb", "pf", "bv")
TIE = "͡"
ASPIRATION = "ʰʱ"

# Sounds of letters that a chart leaves out.
FALLBACK_SOUNDS = {
    "'": "ʔ", "ʼ": "ʔ", "’": "ʔ", "ꞌ": "ʔ", "c": "t͡ʃ", "j": "d͡ʒ", "r": "ɾ", "v": "v", "z": "z", "p": "p",
    "h": "h", "x": "x", "ɣ": "ɣ", "ɲ": "ɲ", "ʒ": "ʒ", "ð": "ð", "đ": "d", "ƒ": "ɸ", "ǝ": "ə", "ə": "ə",
    "ɛ": "ɛ", "ɔ": "ɔ", "ŋ": "ŋ", "ɩ": "ɪ", "ʋ": "ʋ", "ɓ": "ɓ", "ɗ": "ɗ", "ɖ": "ɖ", "ƙ": "kʼ", "w": "w",
    "ẹ": "ɛ", "ọ": "ɔ", "ṣ": "ʃ", "ǀ": "ǀ", "ǁ": "ǁ", "ǃ": "ǃ", "ǂ": "ǂ", "ʘ": "ʘ",
}

# Tone bars written beside a syllable; they stand for no sound.
TONE_BARS = "ˈˉˊˋˌ˗˖"

# Vowels, and the vowel that keeps two sounds apart that meet in one letter.
VOWELS = "aàáãäæèéêëɛəɐɑɒɔɜɞɘɚeẽiĩɪɨɤɵoõöòóôuùũüʊʉɯʏøœyỹʌǝǐịụ"
SHIFTED_VOWEL = {"o": "u", "u": "o", "e": "i", "i": "e", "ɔ": "u", "ɛ": "i", "a": "ə", "ə": "a"}
SHIFTED_VOWEL_SHARED = {"o": "u", "u": "o", "e": "i", "i": "e", "ɔ": "u", "ɛ": "i", "a": "e", "ə": "a"}

# Apostrophes, which the shared spelling does not write.
APOSTROPHES = "'’‘ʼʻ`ꞌꞋ"

# Typographic characters and their ASCII spelling.
ASCII_PUNCTUATION = {
    "«": '"', "»": '"', "‹": "'", "›": "'", "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'",
    "‐": "-", "\u2011": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
    "…": "...", "·": ".", "•": ".", "，": ",", "．": ".",
    "؛": ";", "؟": "?", "،": ",", "؞": ".", "۔": ".", "⁄": "/", "×": "x", "′": "'", "″": '"',
    "‚": "'", "‛": "'", "¿": "?", "¡": "!", "‵": "'", "‶": '"', "º": "o", "ª": "a",
}

# Ranges of non-Latin scripts that are romanised character by character.
NON_LATIN = ((0x1200, 0x137F), (0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0xA500, 0xA63F), (0x07C0, 0x07FF), (0x2D30, 0x2D7F), (0x0400, 0x04FF), (0x2C80, 0x2CFF))

# Script of a character by range.
SCRIPTS = {
    "ethiopic": ((0x1200, 0x137F),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "vai": ((0xA500, 0xA63F),),
    "nko": ((0x07C0, 0x07FF),),
    "tifinagh": ((0x2D30, 0x2D7F),),
    "cyrillic": ((0x0400, 0x04FF),),
    "coptic": ((0x2C80, 0x2CFF),),
}

# Look-alikes in sound values of scanned charts.
SOUND_LOOKALIKES = {"γ": "ɣ", "ε": "ɛ", "ι": "ɪ", "α": "ɑ", "Ɂ": "ʔ", "Ɩ": "ɪ"}

# Placeholders that are no spelling, and sounds that are deliberately not written.
PLACEHOLDERS = ("VV", "V", "C", "CC")
UNWRITTEN = ("∅", "ʔ∅", "ʔ", "ː")

# Digits of an escaped code point; x closes an escape and is no digit.
ESCAPE_DIGITS = "abcdefghijklmnopqrstuvwyz"
# Payloads of combining marks.
MARK_PAYLOADS = {"́": "q", "̀": "w", "̂": "wq", "̌": "qw", "̄": "mq", "̃": "nq", "̈": "jq", "̣": "vq", "̇": "jj", "̱": "mm", "̧": "vv"}

# English sounds of several characters, and codes of English.
ENGLISH_UNITS = ("t͡ʃ", "d͡ʒ", "aɪ", "aʊ", "eɪ", "oʊ", "ɔɪ", "ɪə", "eə", "ʊə", "iː", "uː", "ɑː", "ɔː", "ɜː", "ɚ", "ɝ")
ENGLISH_CODES = ("eng", "en", "eng-us", "eng-gb")

# The one-sound convention of chart values.
CONSONANTS = "pbtdʈɖcɟkɡqɢʔmɱnɳɲŋɴʙrʀⱱɾɽɸβfvθðszʃʒʂʐçʝxɣχʁħʕhɦɬɮʋɹɻjɰlɭʎʟɓɗʄɠʛwʍɥɕʑɺɧ"
SOUND_VOWELS = "iyɨʉɯuɪʏʊeøɘɵɤoəɛœɜɞʌɔæɐaɶɑɒ"
TIED_PAIRS = ("t͡s", "d͡z", "t͡ʃ", "d͡ʒ", "t͡ɕ", "d͡ʑ", "k͡p", "ɡ͡b", "ŋ͡m", "p͡f", "b͡v")
NASAL = "\u0303"
SECONDARY = "ʷʲ"
WRITTEN_VOWELS = "aeiouɛɔəɨ"
