"""Keyword rules kept as data, and the column functions that apply them.

A rule is (alternatives, boost targets); its pattern is the alternatives between word boundaries. Every function here
looks at a text once per objective or document, never once per candidate.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBJECTS = ("ela", "math", "history", "science")

#: Words by which a document's subjects are told.
SUBJECT_WORDS = {
    "ela": (
        r"essay|argument|thesis|claim|narrativ|story|stories|novel|"
        r"poem|poetry|drama|play|literature|literary|read(ing)?|"
        r"writ(e|ing)|grammar|vocabulary|punctuation|paragraph|"
        r"theme|character|plot|setting|figurative|"
        r"shakespeare|odyssey|mockingbird|romeo|juliet|"
        r"speech|present(ation|ing)|discuss(ion)?"
    ),
    "math": (
        r"math(ematic)?|budget|spreadsheet|formula|equation|"
        r"graph(ing)?|chart|data|statistic|probability|"
        r"percentage|percent|fraction|decimal|ratio|proportion|"
        r"algebra|geometry|calculus|trigonometry|"
        r"calculate|compute|sum|average|median|mean|"
        r"income|expense|cost|money|dollar|"
        r"function|variable|coefficient|polynomial"
    ),
    "history": (
        r"history|histor(ical|ic)|civic|government|democracy|"
        r"constitution|amendment|congress|senate|presiden(t|cy)|"
        r"world\s*war|wwii|wwi|"
        r"colonial|revolution(ary)?|civil\s*war|reconstruction|"
        r"slavery|abolition|emancipation|"
        r"ancient|medieval|renaissance|enlightenment|industrial(ization)?|"
        r"empire|civilization|dynasty|"
        r"capitalism|socialism|communism|fascism|"
        r"geography|geographic|continent|hemisphere|"
        r"culture|cultural|religion|religious|"
        r"primary\s*source|secondary\s*source|"
        r"timeline|chronolog(y|ical)|"
        r"election|vote|voting|"
        r"holocaust|"
        r"egypt(ian)?|rome|roman|greek|greece|"
        r"casualt(y|ies)|military|war(s|fare)?"
    ),
    "science": (
        r"science|scientific|hypothesis|experiment|laborator(y|ies)|"
        r"physics|chemistry|biology|biolog(ical|ist)|chemical|"
        r"atom|molecule|element|compound|periodic|isotop|electron|proton|neutron|"
        r"force|motion|gravity|gravitation|friction|momentum|accelerat|velocit|"
        r"energy|kinetic|potential|thermal|electromagnetic|nuclear|"
        r"wave(length|s)?|frequency|amplitude|"
        r"cell|cellular|organism|dna|gene|chromosome|heredit|trait|"
        r"evolution|natural\s*selection|adapt(ation)?|species|biodivers|"
        r"ecosystem|biome|food\s*chain|food\s*web|photosynthesis|respirat|"
        r"weather|climate|atmosphere|hydrosphere|cryosphere|biosphere|"
        r"plate\s*tectonic|earthquake|volcano|erosion|weathering|"
        r"solar\s*system|planet|star|galaxy|universe|astronom|"
        r"engineer(ing)?|design\s*solution|prototype|iterat|"
        r"renewable|fossil\s*fuel|carbon\s*cycle|water\s*cycle|"
        r"organ(ism|s)?|tissue|protein|enzyme|"
        r"newton|einstein|darwin|"
        r"NGSS|disciplinary\s*core"
    ),
}

ELEMENTARY = ("K", "1", "2", "3", "4", "5")
LEVEL_GRADES = {
    "ela": {"HS": ("9-10", "11-12"), "MS": ("6", "7", "8", "6-8"), "ES": ELEMENTARY},
    "math": {"HS": ("9-12",), "MS": ("6", "7", "8"), "ES": ELEMENTARY},
    "history": {"HS": ("10", "11", "12"), "MS": ("6", "7", "8"), "ES": ELEMENTARY},
    "science": {"HS": ("HS",), "MS": ("MS",), "ES": ELEMENTARY},
}

#: Words by which school levels are told, highest first.
LEVEL_WORDS = {
    "HS": (
        r"high school|grade 9|grade 10|grade 11|grade 12|9th|10th|11th|12th|9-10|11-12|odyssey|mockingbird|"
        r"romeo|shakespeare|resume|career|college|calculus|trigonometry|polynomial|logarithm"
    ),
    "MS": (
        r"middle school|grade 6|grade 7|grade 8|6th|7th|8th|6-8|linear equation|proportional relationship|"
        r"scientific notation"
    ),
    "ES": r"elementary|kindergarten|grade [1-5]|[1-5]th grade|place value|skip count|number bonds",
}

#: Words by which history grades are told, with the grades, in order.
HISTORY_ERAS = (
    ((
        r"world\s*war|wwi|wwii|holocaust|cold\s*war|nuclear|civil\s*rights|industrial(ization)?\s*revolution|"
        r"new\s*deal|great\s*depression|vietnam|korean\s*war|french\s*revolution|napoleon"
    ), ("10", "11")),
    ((
        r"democracy|democratic|civic|civil\s*society|market\s*economy|supply\s*and\s*demand|fiscal\s*polic|"
        r"monetary\s*polic|gdp|federal\s*reserve|inflation|unemployment|opportunity\s*cost|scarcity|"
        r"separation\s*of\s*powers|bill\s*of\s*rights"
    ), ("12",)),
    ((
        r"american\s*revolution|founding\s*fathers|declaration\s*of\s*independence|constitution|federalist|"
        r"jefferson|washington|hamilton|madison|civil\s*war|reconstruction|slavery|abolition|emancipation|"
        r"westward\s*expansion|frontier|manifest\s*destiny"
    ), ("8",)),
    ((
        r"medieval|middle\s*ages|renaissance|reformation|feudal|crusade|knight|byzantine|islamic|caliph|"
        r"mongol|aztec|inca|maya(n)?|luther|protestant|enlightenment"
    ), ("7",)),
    ((
        r"ancient|prehistor|mesopotamia|sumeria|egypt(ian)?|hebrew|judaism|greek|greece|roman|rome|hammurabi|"
        r"pharaoh|pyramid|nile|han\s*dynasty|qin|shang"
    ), ("6",)),
    (r"california|gold\s*rush|missions?|\bcalifornia\s*history\b", ("4",)),
)

#: Words by which science levels are told, in order.
SCIENCE_TOPICS = (
    ((
        r"dna|rna|gene\s*expression|chromosome|meiosis|mitosis|cellular\s*respiration|newton|momentum|kinetic|"
        r"atomic\s*structur|periodic\s*table|isotop|radioactiv|natural\s*selection|evolution|punnett|"
        r"plate\s*tectonic|biogeochem|climate\s*change|big\s*bang"
    ), ("HS",)),
    ((
        r"photosynthesis|food\s*web|food\s*chain|chemical\s*reaction|conserv(ation)?\s*of\s*mass|"
        r"thermal\s*energy|kinetic\s*theory|weather\s*pattern|water\s*cycle|ecosystem|biome|species|"
        r"adaptation|earthquake|volcano|rock\s*cycle"
    ), ("MS",)),
    ((
        r"push|pull|five\s*senses|seasons|plant.*animal|living\s*things|weather|sunlight|plant.*need|"
        r"animal.*need"
    ), ELEMENTARY),
)

#: Keyword rules by subject, each with its boost targets: "strand number" (ela), domain (math),
#: code prefix or "SKILL:category" (history), topic (science).
KEYWORD_RULES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "ela": (
        (r"argument|argu(e|ing)|thesis|claim|opinion|persuas|position|stance|debate", ("W 1", "CCRA.W 1")),
        (r"inform|informative|explanatory|explain(ing)?|expository", ("W 2", "CCRA.W 2")),
        (r"narrative|story|short story|anecdot", ("W 3", "CCRA.W 3")),
        (r"outline|organiz(e|ing)|structure|plan(ning)?|prewrit|graphic organizer", ("W 4", "W 5")),
        (r"revis(e|ing|ion)|edit(ing)?|rewrit|peer review", ("W 5", "CCRA.W 5")),
        ((
            r"hyperlink|image|media|multimedia|digital|technology|internet|publish(ing)?|online|document|MLA|"
            r"format"
        ), ("W 6", "CCRA.W 6", "SL 5")),
        (r"research|investigat|sources|gather(ing)?", ("W 7", "W 8")),
        (r"text(ual)? evidence|cite|quotation|support(ing)? evidence|evidence from the text", ("RL 1", "RI 1", "CCRA.R 1")),
        (r"theme|central idea|main idea|overall message", ("RL 2", "RI 2", "CCRA.R 2")),
        (r"character|protagonist|antagonist|setting|plot|scene", ("RL 3", "CCRA.R 3")),
        (r"word choice|figurative|imagery|tone|mood|diction|connotation|denotation|vocabular", ("RL 4", "RI 4", "L 4", "L 5", "CCRA.R 4")),
        (r"grammar|syntax|punctuation|spelling|capitaliz|conventions|subject.?verb", ("L 1", "L 2", "CCRA.L 1", "CCRA.L 2")),
        (r"introduction|introductory|hook|thesis statement|conclu(sion|ding)", ("W 1", "W 2")),
        (r"discuss(ion)?|collaborat|peer|present(ing)?|speaking|oral", ("SL 1", "SL 4", "CCRA.SL 1")),
    ),
    "math": (
        (r"ratio|proportion(al)?|percent(age)?|unit rate|per[- ]?capita", ("6.RP", "7.RP")),
        ((
            r"budget|income|tax(es)?|expense|spending|sav(e|ing)|interest rate|loan|mortgage|salary|wage|paycheck|"
            r"net pay|gross pay|investment|stock|dividend"
        ), ("7.RP", "6.RP", "A-CED", "A-SSE", "F-LE")),
        (r"add(ing|ition)?|subtract(ing|ion)?|multipl(y|ication)|divid(e|ing|ision)|compute|calculat(e|ion)", ("3.OA", "4.OA", "5.OA", "3.NBT", "4.NBT", "5.NBT", "6.NS", "7.NS")),
        (r"fraction|numerator|denominator|equivalent fraction|common denominator|mixed number|improper fraction", ("3.NF", "4.NF", "5.NF")),
        (r"decimal|tenths|hundredths|thousandths|place value|round(ing)?", ("4.NBT", "5.NBT", "5.NF")),
        (r"expression|variable|coefficient|term|simplify|distributive|like terms|substitute", ("6.EE", "7.EE", "A-SSE", "A-APR")),
        (r"equation|inequal|solv(e|ing)|linear equation|system of equations|quadratic", ("8.EE", "A-REI", "A-CED", "7.EE")),
        ((
            r"function|input|output|mapping|linear function|exponential function|slope|y-intercept|"
            r"domain.{0,5}range|rate of change"
        ), ("8.F", "F-IF", "F-BF", "F-LE")),
        ((
            r"shape|polygon|triangle|rectangle|square|circle|angle|congruen|similar(ity)?|transformation|rotat(e|"
            r"ion)|translat(e|ion)|axis of symmetry|area|perimeter|surface area|volume|pythagorean|"
            r"coordinate plane"
        ), ("G-CO", "G-SRT", "G-GMD", "G-MG", "G-GPE", "7.G", "8.G", "6.G", "5.G", "4.G", "3.G", "2.G", "1.G", "K.G")),
        ((
            r"data|graph|chart|plot|histogram|scatter[- ]?plot|bar graph|line graph|box plot|mean|median|mode|"
            r"range|standard deviation|distribution|outlier|correlation|survey|sample|population|inference"
        ), ("S-ID", "S-IC", "6.SP", "7.SP", "8.SP", "3.MD")),
        (r"probabilit(y|ies)|likelihood|chance|random|simulation|outcome|event", ("S-CP", "S-MD", "7.SP")),
        ((
            r"measure|measurement|length|width|height|weight|capacity|liquid volume|customary|metric|meter|liter|"
            r"gram|inch|foot|pound|ounce"
        ), ("K.MD", "1.MD", "2.MD", "3.MD", "4.MD", "5.MD")),
        (r"count(ing)?|cardinal(ity)?|number names|one[- ]to[- ]one|skip count", ("K.CC", "1.NBT", "2.NBT")),
        (r"model|model(ing|ed)? with math|real[- ]?world|problem solv(e|ing)|word problem", ("MP", "A-CED", "F-LE")),
        (r"reason(ing)?|argument|critique|justif(y|ication)|prove|proof|contradict", ("MP",)),
    ),
    "history": (
        ((
            r"world\s*war|wwi|wwii|world\s*war\s*ii|holocaust|nazi|hitler|stalin|pearl\s*harbor|d[- ]?day|"
            r"hiroshima|nagasaki|fascis|nationalis"
        ), ("10.7", "10.8", "11.7")),
        ((
            r"cold\s*war|nuclear|atomic|soviet|ussr|berlin\s*wall|iron\s*curtain|vietnam|korean\s*war|"
            r"cuban\s*missile|decoloniz|third\s*world"
        ), ("10.9", "11.9")),
        ((
            r"civil\s*rights|martin\s*luther\s*king|brown\s*v\.\s*board|segregation|desegregat|integrat(e|ion)|"
            r"jim\s*crow|voting\s*rights|freedom\s*riders|montgomery\s*bus"
        ), ("11.10",)),
        (r"great\s*depression|new\s*deal|dust\s*bowl|\broosevelt\b|hoover|fdr", ("11.6",)),
        (r"roaring\s*twenties|1920s|prohibition|jazz\s*age|flapper|harlem\s*renaissance|mass\s*production", ("11.5",)),
        (r"industrial\s*revolution|industrializ|factory\s*system|steam\s*engine|assembly\s*line", ("10.3", "8.12")),
        ((
            r"american\s*revolution|declaration\s*of\s*independence|founding\s*fathers|federalist\s*paper|"
            r"constitutional\s*convention|articles\s*of\s*confederation|\bbill\s*of\s*rights\b"
        ), ("8.1", "8.2", "8.3", "12.1", "12.4")),
        ((
            r"civil\s*war|reconstruction|slavery|slave\s*trade|abolition|emancipation|underground\s*railroad|"
            r"secession|confederat"
        ), ("8.9", "8.10", "8.11")),
        ((
            r"westward\s*expansion|manifest\s*destiny|frontier|gold\s*rush|oregon\s*trail|louisiana\s*purchase|"
            r"lewis\s*and\s*clark"
        ), ("8.8", "4.3", "4.4")),
        ((
            r"mesopotamia|sumerian|hammurabi|egypt(ian)?|pharaoh|pyramid|nile|hebrew|judaism|ancient\s*greek|"
            r"ancient\s*greece|ancient\s*rome|roman\s*empire|han\s*dynasty|qin|shang|prehistor"
        ), ("6.1", "6.2", "6.3", "6.4", "6.5", "6.6", "6.7")),
        ((
            r"medieval|middle\s*ages|feudal|knight|crusade|renaissance|reformation|protestant|martin\s*luther|"
            r"byzantine|islamic\s*civilization|caliph|mongol|aztec|inca|maya(n)?|enlightenment\s*thinkers?"
        ), ("7.1", "7.2", "7.3", "7.4", "7.5", "7.6", "7.7", "7.8", "7.9", "7.10", "7.11")),
        ((
            r"california\s*history|california\s*indians|\bcalifornia\s*missions?\b|california\s*statehood|"
            r"junipero\s*serra|spanish\s*missions"
        ), ("4.1", "4.2", "4.3", "4.4", "4.5")),
        ((
            r"government|democracy|democratic|separation\s*of\s*powers|checks\s*and\s*balances|federalism|"
            r"judicial\s*review|judiciary|supreme\s*court|legislative|executive|congress|senate|\bvote\b|voting|"
            r"election|campaign|political\s*party|civic|citizenship"
        ), ("12.1", "12.2", "12.3", "12.4", "12.5", "12.6", "12.7", "12.8")),
        ((
            r"market\s*economy|supply\s*and\s*demand|opportunity\s*cost|scarcity|incentive|\bgdp\b|inflation|"
            r"unemployment|fiscal\s*polic|monetary\s*polic|federal\s*reserve|international\s*trade|"
            r"exchange\s*rate|tariff|\bcompetition\b|profit|labor\s*market"
        ), ("12E.1", "12E.2", "12E.3", "12E.4", "12E.5", "12E.6")),
        ((
            r"geography|geographic|map(s|ping)?|continent|hemisphere|latitude|longitude|trade\s*route|migration|"
            r"settlement\s*patterns?"
        ), ("SKILL:CST",)),
        ((
            r"primary\s*source|secondary\s*source|document(ary)?|eyewitness|oral\s*histor|artifact|photograph|"
            r"letter\s*from|diary|point\s*of\s*view|bias|fact\s*from\s*opinion|credibility|verifiable"
        ), ("SKILL:REP",)),
        ((
            r"cause\s*(and|&)\s*effect|cause[- ]effect|causation|causal|consequence|interpretation|"
            r"historical\s*context|point\s*of\s*view|long[- ]term|short[- ]term"
        ), ("SKILL:HI",)),
        ((
            r"timeline|time\s*line|chronology|chronological|sequence\s*of\s*events|era|period\s*of\s*history|"
            r"\bbce?\b|\bce\b|\bb\.c\.|\ba\.d\."
        ), ("SKILL:CST",)),
    ),
    "science": (
        ((
            r"matter|atom(ic|s)?|molecule|element|compound|periodic\s*table|isotop|mass|density|"
            r"chemical\s*reaction|reactant|product|acid|base|ph|solution|solvent|solute"
        ), ("PS1",)),
        ((
            r"force|push|pull|motion|gravity|gravitation|friction|momentum|acceleration|velocit|newton|balance|"
            r"equilibrium|inertia"
        ), ("PS2",)),
        ((
            r"energy|kinetic|potential|thermal|heat|electric(al|ity)|magnet(ic|ism)?|electromagnetic|nuclear|"
            r"conservation\s*of\s*energy|power|joule|watt"
        ), ("PS3",)),
        ((
            r"wave(length|s)?|sound|light|frequency|amplitude|reflection|refraction|electromagnetic\s*spectrum|"
            r"radio|infrared|ultraviolet|information\s*transfer|signal|digital"
        ), ("PS4",)),
        ((
            r"cell|cellular|organelle|nucleus|membrane|mitochondri|chloroplast|tissue|organ|organ\s*system|"
            r"protein|enzyme|metabolism|photosynthesis|cellular\s*respiration|homeostasis|immune"
        ), ("LS1",)),
        ((
            r"ecosystem|biome|food\s*chain|food\s*web|producer|consumer|decomposer|herbivore|carnivore|predator|"
            r"prey|competition|symbios|population|community|niche|carrying\s*capacity|biomass"
        ), ("LS2",)),
        ((
            r"heredity|inherit(ance)?|trait|dna|rna|gene|chromosome|genom|meiosis|mitosis|punnett|allele|genotyp|"
            r"phenotyp|mutation|sexual\s*reproduction|asexual"
        ), ("LS3",)),
        ((
            r"evolution|natural\s*selection|adaptation|common\s*ancestor|biodivers|extinct|darwin|species|"
            r"speciation|fossil\s*record"
        ), ("LS4",)),
        ((
            r"solar\s*system|planet|moon|star(s)?|galaxy|universe|big\s*bang|cosmolog|astronom|telescope|orbit|"
            r"eclipse|sun|earth|seasons"
        ), ("ESS1",)),
        ((
            r"plate\s*tectonic|earthquake|volcano|mountain|weather|climate|atmosphere|hydrosphere|erosion|"
            r"weathering|sediment|rock\s*cycle|water\s*cycle|ocean|continent|geosphere"
        ), ("ESS2",)),
        ((
            r"natural\s*resource|natural\s*hazard|climate\s*change|global\s*warm|renewable|nonrenewable|"
            r"fossil\s*fuel|pollution|sustainab|conservation|human\s*impact|biodivers"
        ), ("ESS3",)),
        ((
            r"engineer(ing)?|design\s*solution|design\s*problem|prototype|iterat|criteria|constraint|"
            r"design\s*process|test.*design|trade[- ]?off"
        ), ("ETS1",)),
    ),
}

#: Titles and contexts of objectives that get no tag.
LOGISTICS_CONTEXT = (
    r"file.?name|naming|watch me|do not continue|project setup|mla heading|heading|"
    r"insert section|submit|turn[- ]?in|upload|name your file"
)

REFLECTIVE_TITLE = (
    r"^\s*(?:[A-Za-z0-9 /&-]*\b)?"
    r"(reflection|reflect on|metacognit|takeaways?|what did you learn|ai (?:prompt|reflection|critical thinking))\s*\d*\s*$"
)

#: Evaluation types, audiences and words of objectives that are not tasks for students.
EDUCATOR_TYPES, EDUCATOR_AUDIENCES = ("ai", "ai_assistant", "teacher"), ("educator", "teacher")
LOGISTICS_WORDS = (
    r"naming convention|rename your file|file name|filename|section break|upload to|google classroom|"
    r"submit (by|before)|due date|create an account|platform setup|data test|double-?spaced|12-?point font|mla heading|"
    r"the (ai|teacher) will (evaluate|assess|grade)|gemini will|grading criteria|rubric for grading|you will grade|facilitation guide"
)
ACADEMIC_WORDS = (
    r"analyze|analysis|argue|argument|cite|evidence|thesis|write|essay|paragraph|solve|equation|graph|function|compare|"
    r"contrast|summarize|interpret|research"
)
LOGISTICS_PREFIX = r"^(insert|add|rename|title your|name your|upload|attach|create a section)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pattern_of(alternatives: str) -> str:
    return rf"\b({alternatives})\b"


def _has(col: Column | str, alternatives: str) -> Column:
    return F.coalesce(_c(col), F.lit("")).rlike("(?iu)" + pattern_of(alternatives))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def detect_subjects(col: Column | str) -> Column:
    """All subjects whose words the text has, found in one pass; `ela` if there is none."""
    from .matcher import Rule, matcher

    found = matcher([Rule(s, SUBJECT_WORDS[s], ()) for s in SUBJECTS])(col)
    return F.when(F.size(found) == 0, _strings(["ela"])).otherwise(F.transform(found, lambda n: F.get(_strings(SUBJECTS), n)))


def _first_level(col: Column | str, subject: str) -> Column:
    out = None
    for level, words in LEVEL_WORDS.items():
        grades = _strings(LEVEL_GRADES[subject][level])
        out = F.when(_has(col, words), grades) if out is None else out.when(_has(col, words), grades)
    return out.otherwise(_strings([]))


def _all_of(col: Column | str, rules) -> Column:
    return F.flatten(F.array(*(F.when(_has(col, words), _strings(grades)).otherwise(_strings([])) for words, grades in rules)))


def infer_grades_ela(col: Column | str) -> Column:
    return _first_level(col, "ela")


def infer_grades_math(col: Column | str) -> Column:
    return _first_level(col, "math")


def infer_grades_history(col: Column | str) -> Column:
    """Grades of all eras that the text names; school levels only where it names none."""
    eras = F.array_distinct(_all_of(col, HISTORY_ERAS))
    return F.when(F.size(eras) > 0, eras).otherwise(_first_level(col, "history"))


def infer_grades_science(col: Column | str) -> Column:
    """Levels of all topics, then those of the school levels that are named."""
    return F.array_distinct(F.concat(_all_of(col, SCIENCE_TOPICS), _all_of(col, [(w, LEVEL_GRADES["science"][k]) for k, w in LEVEL_WORDS.items()])))


def infer_grades(col: Column | str, subject: Column | str = "subject") -> Column:
    """The inferred grades under each row's subject; other subjects count as ela."""
    s = _c(subject)
    return F.when(s == "math", infer_grades_math(col)).when(s == "history", infer_grades_history(col)).when(s == "science", infer_grades_science(col)).otherwise(infer_grades_ela(col))


@cache
def split_alternatives(words: str) -> tuple[str, ...]:
    """The alternatives of a rule, those inside parentheses left together."""
    parts, depth = [""], 0
    for token in re.findall(r"\\.|.", words):
        depth += (token in "([") - (token in ")]")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
    return tuple(parts)


def match_rules(col: Column | str, subject: str, rules=None) -> Column:
    """Struct of the names (first 60 characters of the pattern) and the union of targets of all rules that a text matches, in rule order.

    Each pattern is tried apart, which suits short texts and few rules; see matcher.py for one pass over long ones."""
    rules = KEYWORD_RULES[subject] if rules is None else rules
    hits = F.array_compact(F.array(*(F.when(_has(col, words), F.struct(F.lit(pattern_of(words)[:60]).alias("name"), _strings(targets).alias("targets"))) for words, targets in rules)))
    return F.struct(F.transform(hits, lambda h: h["name"]).alias("matched"), F.array_distinct(F.flatten(F.transform(hits, lambda h: h["targets"]))).alias("boosts"))


def match_rules_of(col: Column | str, subject: Column | str = "subject") -> Column:
    s = _c(subject)
    math, history, science, ela = (match_rules(col, x) for x in ("math", "history", "science", "ela"))
    return F.when(s == "math", math).when(s == "history", history).when(s == "science", science).otherwise(ela)


def counts_toward_coverage(evaluation_type: Column | str, audience: Column | str, *texts: Column | str, product: str = "") -> Column:
    """Whether an objective is a task for students, by its type, its audience and the words of its texts.

    `product` is the name of the platform that texts may speak of: that it can identify something is logistics too.
    """
    kind, to = F.lower(F.coalesce(_c(evaluation_type), F.lit(""))), F.lower(F.coalesce(_c(audience), F.lit("")))
    text = F.concat_ws(" ", *(F.nullif(_c(t), F.lit("")) for t in texts))

    def has(words: str) -> Column:
        return text.rlike(rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])")

    logistics, academic = has(LOGISTICS_WORDS + (f"|{re.escape(product)} can identify" if product else "")), has(ACADEMIC_WORDS)
    prefix = F.trim(text).rlike("(?i)" + LOGISTICS_PREFIX)
    out = kind.isin(*EDUCATOR_TYPES) | to.isin(*EDUCATOR_AUDIENCES) | ((kind == "platform") & logistics) | (logistics & ~academic) | (prefix & ~academic)
    return ~out


def shows_in_report(evaluation_type: Column | str, audience: Column | str, tags: Column | str, *texts: Column | str, product: str = "") -> Column:
    """Whether an objective counts toward coverage and has a tag."""
    return counts_toward_coverage(evaluation_type, audience, *texts, product=product) & (F.coalesce(F.size(_c(tags)), F.lit(0)) > 0)


def skip_reason(title: Column | str, context: Column | str, top_score: Column | str, product: str = "") -> Column:
    """`reflective`, `logistical` (only where the best score is under 0.35), or null. An introduction to the platform named `product` is logistics."""
    name, top = F.trim(F.coalesce(_c(title), F.lit(""))), _c(top_score)
    return F.when((name != "") & name.rlike("(?iu)" + REFLECTIVE_TITLE), "reflective").when(_has(context, LOGISTICS_CONTEXT + (f"|{re.escape(product)} intro" if product else "")) & (top < 0.35), "logistical")
