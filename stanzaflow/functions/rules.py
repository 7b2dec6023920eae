"""Patterns, labels, titles and the canon table. Nothing here decides anything."""

# --- fixed values that results depend on ---
STRIPPED = "\x00\t\n\x0b\f\r "
TOKEN = r"\p{L}[\p{L}\p{M}]*+(?:[-'’]\p{L}[\p{L}\p{M}]*+)*+|[0-9]++"
DIGITS = r"^[0-9]+\z"
VERSE = r"(?s)^([0-9]+)[ \t\n\x0B\f\r]+(.+)\z"
LEAD = r"^([0-9]+)(?:[ \t\n\x0B\f\r]|\z)"
PSALM = r"^PSALM [0-9]+\z"
STANZAS = "ALEPH. BETH. GIMEL. DALETH. HE. VAU. ZAIN. CHETH. TETH. JOD. CAPH. LAMED. MEM. NUN. SAMECH. AIN. PE. TZADDI. KOPH. RESH. SCHIN. TAU.".split()
NO_WORD_AFTER = r"(?![\p{L}\p{M}\p{Nd}\p{Pc}])"
HEADINGS = (
    r"To the chief Musician", r"A Psalm and Song", r"A Song and Psalm\b", r"A Psalm for ", r"A Song or Psalm\b", r"A Psalm or Song\b", r"A Psalm of ", r"Maschil\b",
    r"Michtam\b", r"Shiggaion\b", r"A Prayer of ", r"A Song of degrees", r"A Song of ", r"A Psalm\.\z", r"David[’']s Psalm of praise",
)
COLOPHONS = (
    r"^\[(The end|This ends).*\]\z", r"^Or the (foregoing|preceding).*\z", r"^Written from ", r"^The .+ written from .+\.\z", r"^Written to the .+",
    r"^Unto the .+ written from\b", r"^It was written to .+\bfrom\b",
)
TITLE_LINES = (
    "THE BOOK OF THE PROPHET", "THE LAMENTATIONS", "THE GENERAL EPISTLE OF", "THE THIRD EPISTLE OF", "THE REVELATION", "OF", "ST. JOHN THE DIVINE.",
    "FIRST EPISTLE OF PAUL THE APOSTLE", "SECOND EPISTLE OF PAUL THE APOSTLE", "HOLY BIBLE", "KING JAMES VERSION", "THE", "CALLED", "THE GOSPEL ACCORDING TO",
    "OTHERWISE CALLED,", "COMMONLY CALLED,", "THE FIRST", "THE SECOND", "TO THE",
)
TITLE_PATTERNS = (
    r"THE (FIRST|SECOND|THIRD|FOURTH|FIFTH) BOOK OF MOSES,?", r"(FIRST|SECOND) BOOK OF [A-Z ]+,?", r"THE (FIRST|SECOND) BOOK OF THE", r"THE (FIRST|SECOND) BOOK OF THE [A-Z]+\.",
    r"BOOK OF THE KINGS[,.]", r"THE (THIRD|FOURTH) BOOK OF THE KINGS\.", r"THE EPISTLE OF PAUL THE APOSTLE", r"THE EPISTLE OF PAUL TO", r"EPISTLE OF PAUL THE APOSTLE TO",
    r"THE (FIRST|SECOND) EPISTLE GENERAL OF", r"THE SECOND EPISTLE OF", r"THE BOOK OF .+\.", r"PSALM [0-9]+", r"ST\. [A-Z.]+", r"OR, .+\.",
    r"[A-Z][A-Z \t\n\x0B\f\r,'-]+\.", r"[A-Z][A-Z \t\n\x0B\f\r,]+;", r"[A-Z]{3,}\.",
)
PSALMS_START, PSALMS_END = "BOOK OF PSALMS.", "THE PROVERBS."
FRONT = "Front matter"
CATEGORIES = ("chapter", "verse", "psalm_heading", "psalm_119_division", "colophon", "book_title", "unclassified_text", "other")
KINDS = (
    "split_verse_body", "psalm_119_division", "psalm_title", "psalm_heading", "verse_after_psalm_heading", "implicit_psalm_opening", "split_verse_number", "numbered_line",
)
COUNTERS = (
    "text_words", "verse_text_words", "psalm_heading_words", "psalm_119_division_words", "chapter_numbers", "verse_numbers",
    "psalm_chapter_titles", "numeric_chapter_lines", "implicit_psalm_verse_1", "numbered_verse_lines",
)
COMBINED = COUNTERS[:6]
#: book, chapters, verses, in canon order
CANON = (
    ("Genesis", 50, 1533), ("Exodus", 40, 1213), ("Leviticus", 27, 859), ("Numbers", 36, 1288), ("Deuteronomy", 34, 959), ("Joshua", 24, 658), ("Judges", 21, 618), ("Ruth", 4, 85),
    ("1 Samuel", 31, 810), ("2 Samuel", 24, 695), ("1 Kings", 22, 816), ("2 Kings", 25, 719), ("1 Chronicles", 29, 942), ("2 Chronicles", 36, 822), ("Ezra", 10, 280),
    ("Nehemiah", 13, 406), ("Esther", 10, 167), ("Job", 42, 1070), ("Psalms", 150, 2461), ("Proverbs", 31, 915), ("Ecclesiastes", 12, 222), ("Song of Solomon", 8, 117),
    ("Isaiah", 66, 1292), ("Jeremiah", 52, 1364), ("Lamentations", 5, 154), ("Ezekiel", 48, 1273), ("Daniel", 12, 357), ("Hosea", 14, 197), ("Joel", 3, 73), ("Amos", 9, 146),
    ("Obadiah", 1, 21), ("Jonah", 4, 48), ("Micah", 7, 105), ("Nahum", 3, 47), ("Habakkuk", 3, 56), ("Zephaniah", 3, 53), ("Haggai", 2, 38), ("Zechariah", 14, 211),
    ("Malachi", 4, 55), ("Matthew", 28, 1071), ("Mark", 16, 678), ("Luke", 24, 1151), ("John", 21, 879), ("Acts", 28, 1007), ("Romans", 16, 433), ("1 Corinthians", 16, 437),
    ("2 Corinthians", 13, 257), ("Galatians", 6, 149), ("Ephesians", 6, 155), ("Philippians", 4, 104), ("Colossians", 4, 95), ("1 Thessalonians", 5, 89),
    ("2 Thessalonians", 3, 47), ("1 Timothy", 6, 113), ("2 Timothy", 4, 83), ("Titus", 3, 46), ("Philemon", 1, 25), ("Hebrews", 13, 303), ("James", 5, 108), ("1 Peter", 5, 105),
    ("2 Peter", 3, 61), ("1 John", 5, 105), ("2 John", 1, 13), ("3 John", 1, 14), ("Jude", 1, 25), ("Revelation", 22, 404),
)
#: line that starts a book -> that book
TRIGGERS = {
    "GENESIS.": "Genesis", "EXODUS.": "Exodus", "LEVITICUS.": "Leviticus", "NUMBERS.": "Numbers", "DEUTERONOMY.": "Deuteronomy", "THE BOOK OF JOSHUA.": "Joshua",
    "THE BOOK OF JUDGES.": "Judges", "THE BOOK OF RUTH.": "Ruth", "FIRST BOOK OF SAMUEL,": "1 Samuel", "SECOND BOOK OF SAMUEL,": "2 Samuel", "THE THIRD BOOK OF THE KINGS.": "1 Kings",
    "THE FOURTH BOOK OF THE KINGS.": "2 Kings", "EZRA.": "Ezra", "BOOK OF NEHEMIAH.": "Nehemiah", "BOOK OF ESTHER.": "Esther", "THE BOOK OF JOB.": "Job", "BOOK OF PSALMS.": "Psalms",
    "THE PROVERBS.": "Proverbs", "ECCLESIASTES;": "Ecclesiastes", "SONG OF SOLOMON.": "Song of Solomon", "ISAIAH.": "Isaiah", "JEREMIAH.": "Jeremiah", "THE LAMENTATIONS": "Lamentations",
    "EZEKIEL.": "Ezekiel", "THE BOOK OF DANIEL.": "Daniel", "HOSEA.": "Hosea", "JOEL.": "Joel", "AMOS.": "Amos", "OBADIAH.": "Obadiah", "JONAH.": "Jonah", "MICAH.": "Micah",
    "NAHUM.": "Nahum", "HABAKKUK.": "Habakkuk", "ZEPHANIAH.": "Zephaniah", "HAGGAI.": "Haggai", "ZECHARIAH.": "Zechariah", "MALACHI.": "Malachi", "ST. MATTHEW.": "Matthew",
    "ST. MARK.": "Mark", "ST. LUKE.": "Luke", "ST. JOHN.": "John", "ACTS OF THE APOSTLES.": "Acts", "ROMANS.": "Romans", "GALATIANS.": "Galatians", "EPHESIANS.": "Ephesians",
    "PHILIPPIANS.": "Philippians", "COLOSSIANS.": "Colossians", "TITUS.": "Titus", "PHILEMON.": "Philemon", "HEBREWS.": "Hebrews", "JAMES.": "James", "JUDE.": "Jude",
    "ST. JOHN THE DIVINE.": "Revelation",
}
#: trigger line, whether only the line before counts (else: anywhere in the ten lines before), text there, book; the first that holds wins
AMBIGUOUS = (
    ("CHRONICLES.", True, "THE FIRST BOOK OF THE", "1 Chronicles"), ("CHRONICLES.", True, "THE SECOND BOOK OF THE", "2 Chronicles"),
    ("CORINTHIANS.", False, "FIRST EPISTLE OF PAUL THE APOSTLE", "1 Corinthians"), ("CORINTHIANS.", False, "SECOND EPISTLE OF PAUL THE APOSTLE", "2 Corinthians"),
    ("THESSALONIANS.", False, "FIRST EPISTLE OF PAUL THE APOSTLE", "1 Thessalonians"), ("THESSALONIANS.", False, "SECOND EPISTLE OF PAUL THE APOSTLE", "2 Thessalonians"),
    ("TIMOTHY.", False, "FIRST EPISTLE OF PAUL THE APOSTLE TO", "1 Timothy"), ("TIMOTHY.", False, "SECOND EPISTLE OF PAUL THE APOSTLE TO", "2 Timothy"),
    ("PETER.", False, "FIRST EPISTLE GENERAL OF", "1 Peter"), ("PETER.", False, "SECOND EPISTLE GENERAL OF", "2 Peter"),
    ("JOHN.", False, "FIRST EPISTLE GENERAL OF", "1 John"), ("JOHN.", False, "SECOND EPISTLE OF", "2 John"), ("JOHN.", False, "THIRD EPISTLE OF", "3 John"),
)
