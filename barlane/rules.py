"""Pattern groups of the detectors. The patterns, words, weights and caps are fixed values: results depend on each of them."""
from __future__ import annotations

from typing import NamedTuple


class Group(NamedTuple):
    """Each pattern counts once; points are min(hits * per_hit, cap). The first `keep` hits give evidence, `pad` characters wide."""

    per_hit: float
    cap: float
    keep: int
    pad: int
    patterns: tuple[str, ...]


# Fixed values.
GROUPS: dict[str, list[Group]] = {
    "alley_oop": [
        Group(0.4, 0.8, keep=2, pad=35, patterns=(
            r"\bset(?:ting)?\s+(?:him|them|you|it)\s+up\b",
            r"\bpass(?:ed|ing)?\s+(?:him|them|it|me)\s+(?:the|a)\s+\w+",
            r"\btag(?:ged|ging)?\s+(?:in|out)\b",
            r"\b(?:my\s+)?(?:partner|teammate|co[\s-]writer)\s+(?:said|told|wrote|set)",
            r"\bthat(?:\'s|\s+was)\s+the\s+set[\s-]?up\b",
            r"\b(?:alley[\s-]?oop|assist(?:ed)?)\b",
            r"\bhe\s+(?:set|gave|passed)\s+(?:me|it)\s+(?:up|over)\b",
        )),
    ],
    "and_1": [
        Group(0.35, 0.85, keep=2, pad=40, patterns=(
            r"\[(?:talks?\s+over|speaks?\s+over|interrupts?|yelling|crowd\s+interference)\]",
            r"\b(?:you\s+(?:yelling|talking|screaming)\s+(?:through|during|in)\s+my\s+(?:round|setup|bar))\b",
            r"\b(?:punch(?:es?)?\s+(?:through|past)\s+(?:the\s+)?(?:noise|resistance|interference))\b",
            r"\b(?:even\s+(?:while|with|through)\s+(?:you|them|the\s+crowd)\s+(?:talking|yelling|interrupting))\b",
            r"\b(?:bar\s+(?:still\s+)?(?:landed|hit|scored)\s+(?:through|despite))\b",
            r"\b(?:punch\s+(?:still\s+)?connects?\s+(?:even\s+)?(?:through|while))\b",
            r"\b(?:interrupting\s+only\s+(?:made|proves?|shows?))\b",
            r"\b(?:talking\s+through\s+my\s+setup\s+won'?t)\b",
        )),
    ],
    "fast_break": [
        Group(0.25, 0.55, keep=2, pad=35, patterns=(
            r"\bcombo\b",
            r"\bone,?\s+two,?\s+(?:three|punch)\b",
            r"\bpunch\s+after\s+punch\b|\bbar\s+after\s+bar\b|\bhit\s+after\s+hit\b",
            r"\b(?:run\s+of\s+(?:bars?|punches?)|opening\s+run|closing\s+(?:run|push))\b",
            r"\bkept\s+(?:coming|hitting|punching)\b",
            r"\b(?:wave\s+after\s+wave|volley|barrage)\b",
        )),
    ],
    "three_pointer": [
        Group(0.18, 0.55, keep=2, pad=35, patterns=(
            r"\b(?:back\s+in|way\s+back|remember\s+when|back\s+when)\b",
            r"\byour\s+(?:history|past|record|career|track\s+record|reputation|background)\b",
            r"\b(?:public\s+record|on\s+(?:record|camera|tape|video|film))\b",
            r"\b(?:looked\s+(?:you|it)\s+up|researched|investigated|dug\s+(?:up|into))\b",
            r"\bbefore\s+(?:this|tonight|today|the\s+battle)\b",
            r"\byears?\s+ago\b",
        )),
        Group(0.2, 0.4, keep=1, pad=35, patterns=(
            r"\b(?:calculated|premeditated|planned|studied|prepared|researched)\b",
            r"\b(?:three\s+pointer|long\s+(?:range|shot)|deep\s+(?:ball|shot))\b",
            r"\b(?:from\s+(?:deep|distance|far|afar|way\s+out))\b",
        )),
    ],
    "euro_step": [
        Group(0.2, 0.35, keep=1, pad=35, patterns=(
            r"\b(?:misdirect(?:ed)?|pivot(?:ed)?|redirect(?:ed)?|angle\s+shift)\b",
            r"\b(?:fake\s+out?|feint(?:ed)?|faked)\b",
            r"\b(?:didn'?t\s+(?:see\s+it|expect)\s+coming)\b",
        )),
    ],
    "steal": [
        Group(0.25, 0.65, keep=2, pad=35, patterns=(
            r"\byou\s+said\b",
            r"\byou\s+came\s+(?:in\s+here|out|up)\s+(?:talking|saying|claiming|bragging)\b",
            r"\bsame\s+(?:\w+\s+){1,4}you\s+(?:used|said|tried|came\s+with)\b",
            r"\byou(?:r)?\s+own\s+(?:words?|bars?|angle|setup|lines?)\b",
            r"\b(?:using|flip(?:ped)?|turned)\s+(?:your|his|her)\s+own\s+(?:bar|line|setup|angle|words?)\b",
            r"\bthat\s+(?:same|very)\s+(?:bar|line|angle|setup)\s+you\b",
            r"\byou\s+handed\s+(?:me|us)\s+(?:the\s+)?(?:ammo|material|gun|weapon)\b",
        )),
        Group(0.15, 0.35, keep=1, pad=35, patterns=(
            r"\b(?:let\s+me\s+address|wait\s+(?:wait|hold|no)|hold\s+on|clap\s+back|rebuttal)\b",
            r"\b(?:you\s+(?:lied|made\s+that\s+up|forgot|didn'?t\s+know))\b",
            r"\bflip\s+(?:the\s+)?script\b",
            r"\bthat'?s?\s+(?:ironic|funny)\s+because\b",
            r"\becho\b",
        )),
    ],
    "crossover": [
        Group(0.25, 0.7, keep=3, pad=35, patterns=(
            r"\b(?:switch(?:ed)?\s+(?:up|it\s+up)|flip(?:ped)?\s+(?:the\s+)?(?:script|style|delivery))\b",
            r"\b(?:change\s+of\s+(?:pace|tone|register|style|gear|tempo))\b",
            r"\b(?:sped?\s+(?:it\s+)?up|slowed?\s+(?:it\s+)?down)\b",
            r"\b(?:tempo\s+(?:change|shift|drop))\b",
            r"\b(?:code[\s-]switch(?:ed)?|different\s+energy|switched\s+lanes?)\b",
            r"\b(?:went\s+from\s+\w+\s+to\s+\w+)\b",
        )),
    ],
    "hook_shot": [
        Group(0.2, 0.5, keep=2, pad=35, patterns=(
            r"\b(?:came\s+from\s+(?:the\s+)?(?:side|angle|left|right|back|blind\s+side))\b",
            r"\b(?:went\s+around|didn'?t\s+come\s+(?:straight|directly\s+at))\b",
            r"\b(?:curved|arc(?:ed)?|hook)\b",
            r"\b(?:indirect|roundabout|circumvent|bypass)\b",
        )),
    ],
    "out_the_gate": [
        Group(0.35, 0.7, keep=2, pad=45, patterns=(
            r"\b(?:out\s+(?:the|of\s+the)\s+gate)\b",
            r"\b(?:from\s+(?:the\s+)?(?:jump|start|top|gate|beginning|first\s+bar))\b",
            r"\b(?:opened?\s+(?:the\s+)?(?:round|battle|set))\b",
            r"\b(?:first\s+(?:bar|line|few\s+bars?)\s+(?:in|hit|landed))\b",
            r"\b(?:so\s+much\s+pressure\s+in\s+the\s+first)\b",
            r"\b(?:started?\s+(?:so\s+)?(?:strong|hard|cold|hot|fast))\b",
        )),
    ],
    "fourth_quarter": [
        Group(0.35, 0.7, keep=2, pad=45, patterns=(
            r"\b(?:closed?\s+(?:the\s+)?(?:round|battle)\s+(?:like|with|so))\b",
            r"\b(?:ended?\s+(?:the\s+)?round\s+(?:so|with|like))\b",
            r"\b(?:(?:last|final|closing)\s+(?:bar|bars?|shot|punch|push))\b",
            r"\b(?:fourth[\s-]quarter|buzzer[\s-]beater)\b",
            r"\b(?:finished\s+(?:so\s+)?(?:cold|hot|hard|strong))\b",
            r"\b(?:outro|closing\s+(?:run|push|stretch))\b",
            r"\b(?:curtain\s+closer|lights\s+out|signed\s+off)\b",
        )),
    ],
    "spin_move": [
        Group(0.3, 0.75, keep=2, pad=50, patterns=(
            r"\byou\s+(?:said|call|claim)\s+.{5,60}(?:funny|ironic|crazy|wild|but)\b",
            r"\byou\s+(?:said|call)\s+(?:i|me)\s+.{3,40}(?:but|yet|funny\s+how)\b",
            r"\b(?:ironic|funny|crazy|wild)\s+(?:how|that|because|since)\s+you\b",
            r"\b(?:the\s+same\s+one\s+who|but\s+you'?re?\s+the\s+one\s+who)\b",
            r"\b(?:you\s+brag|you\s+claim)\s+.{5,60}(?:but|yet)\b",
            r"\byour\s+own\s+(?:logic|argument|angle|point)\s+(?:backfires?|works?\s+against|proves?)\b",
            r"\b(?:using\s+your\s+(?:own\s+)?angle|turning\s+(?:it|that|your\s+point)\s+(?:back|around))\b",
        )),
        Group(0.2, 0.35, keep=1, pad=35, patterns=(
            r"\b(?:spin\s+move|angle\s+flip|reverse(?:d)?|backfired?)\b",
            r"\b(?:irony|hypocrite|contradict|pot\s+calling\s+the\s+kettle)\b",
        )),
    ],
    "post_move": [
        Group(0.28, 0.75, keep=2, pad=50, patterns=(
            r"\b(?:let'?s?\s+talk\s+about\s+(?:you|who\s+you\s+(?:really\s+)?are))\b",
            r"\b(?:forget\s+(?:your\s+)?(?:clique|crew|bars?|stories?|persona|reputation))\b",
            r"\b(?:who\s+you\s+(?:really|actually)\s+are)\b",
            r"\b(?:peel\s+back\s+(?:the\s+)?(?:layers?|mask|lies?|truth))\b",
            r"\b(?:i'?m\s+(?:not\s+)?(?:attacking|going\s+after)\s+(?:your\s+bars?|the\s+person))\b",
            r"\b(?:the\s+(?:real|true|actual)\s+(?:you|version\s+of\s+you))\b",
            r"\b(?:behind\s+(?:the\s+)?(?:persona|mask|image|bars?|front))\b",
            r"\b(?:stripped?\s+(?:down|away)|expose\s+(?:who\s+you|the\s+real))\b",
        )),
    ],
    "pick_and_roll": [
        Group(0.35, 0.8, keep=2, pad=40, patterns=(
            r"\b(?:i\s+(?:set\s+(?:myself|that)\s+up|gave\s+myself|threw\s+(?:it|the\s+setup)\s+to\s+myself))\b",
            r"\b(?:self[\s-]alley[\s-]oop|passed\s+(?:it\s+)?to\s+myself)\b",
            r"\b(?:i\s+(?:built|loaded|stacked|set)\s+(?:the\s+)?(?:setup|scheme|trap)\s+(?:for\s+myself|myself))\b",
            r"\b(?:nobody\s+(?:assist(?:ing|ed)?|help(?:ing|ed)?)\s+(?:my|this)\s+(?:career|round))\b",
            r"\b(?:i\s+(?:pitched|rolled|screened)\s+(?:it|that)\s+(?:soft|to\s+myself|then\s+slam))\b",
        )),
    ],
    "isolation": [
        Group(0.3, 0.7, keep=2, pad=40, patterns=(
            r"\b(?:for\s+(?:eight|8|sixteen|16|the\s+whole|all)\s+(?:bars?|round|lines?))\b",
            r"\b(?:(?:the\s+)?whole\s+round\s+(?:i'?m\s+on|on)\s+(?:just\s+)?you)\b",
            r"\b(?:stay\s+(?:right\s+)?there|don'?t\s+(?:look|move|run))\b",
            r"\b(?:i'?m\s+cooking\s+(?:just|only)\s+you)\b",
            r"\b(?:one\s+(?:angle|target|focus|topic)\s+(?:all\s+round|the\s+whole|start\s+to\s+finish))\b",
            r"\b(?:iso(?:lation)?|singled?\s+out|one[\s-]on[\s-]one|personal\s+foul)\b",
            r"\b(?:can'?t\s+escape\s+(?:when\s+i|the\s+iso))\b",
        )),
    ],
    "breakaway": [
        Group(0.25, 0.55, keep=2, pad=40, patterns=(
            r"\b(?:kept\s+(?:going|flowing|cooking|running)|didn'?t\s+stop)\b",
            r"\b(?:clean\s+(?:run|streak|stretch|flow)|smooth\s+(?:run|flow))\b",
            r"\b(?:no\s+(?:breaks?|stops?|stumbles?|pauses?))\b",
            r"\b(?:rolling|momentum|streak|straight\s+through)\b",
            r"\b(?:eight\s+bars?\s+(?:in|straight|clean)|(?:eight|8)\s+clean\s+bars?)\b",
            r"\b(?:uninterrupted|non[\s-]stop)\b",
        )),
    ],
    "midrange": [
        Group(0.12, 0.45, keep=2, pad=35, patterns=(
            r"\breceipts?\b|\bproof\b|\bevidence\b|\bdocumented\b|\bverified\b",
            r"\byou\s+(?:said|did|were|never|always|used\s+to)\b",
            r"\bcheck\s+(?:the\s+)?(?:record|tape|footage|history)\b",
            r"\b(?:exposed?|proven?|shown|clear|obvious|facts?|check)\b",
            r"\b(?:truth|real|genuine|authentic|credible?)\b",
        )),
    ],
    "layup": [
        Group(0.12, 0.45, keep=2, pad=35, patterns=(
            r"\byou\s+(?:can'?t|couldn'?t|don'?t)\b",
            r"\byou\s+(?:ain'?t|aren'?t|weren'?t|never\s+(?:were|was|have\s+been))\b",
            r"\b(?:no\s+cap|no\s+lie|facts?\s+only|just\s+facts)\b",
            r"\b(?:bottom\s+line|point\s+blank|plain\s+and\s+simple|straight\s+up)\b",
            r"\b(?:simple|basic|plain|real\s+talk|straight)\b",
        )),
    ],
    "rebound": [
        Group(0.22, 0.55, keep=2, pad=35, patterns=(
            r"\b(?:recovered?|bounced?\s+back|came\s+back|got\s+back)\b",
            r"\b(?:still\s+came|still\s+hit|still\s+landed|still\s+won)\b",
            r"\b(?:recovery|comeback|come\s+back|rebound)\b",
            r"\b(?:even\s+after\s+(?:that|the|stumbling|choking|forgetting))\b",
            r"\b(?:came\s+back\s+(?:harder|stronger|better))\b",
        )),
    ],
    "no_look_pass": [
        Group(0.3, 0.8, keep=2, pad=45, patterns=(
            r"\b(?:wasn'?t\s+even\s+(?:aiming|trying|targeting)\s+(?:at\s+)?you)\b",
            r"\b(?:(?:off|out)\s+the\s+(?:top|cuff|dome|head))\b",
            r"\b(?:accidentally|by\s+accident|didn'?t\s+mean\s+to)\b",
            r"\b(?:i\s+wasn'?t\s+even\s+(?:looking|aiming|focused\s+on\s+you))\b",
            r"\b(?:(?:said|dropped)\s+it\s+(?:casually|offhand|in\s+passing|without\s+trying))\b",
            r"\b(?:wrote\s+this\s+(?:part\s+)?for\s+nobody)\b",
            r"\b(?:slipped?\s+(?:that|it)\s+in\s+(?:casually|quietly|without))\b",
            r"\b(?:no[\s-]look|sleeper|hidden\s+punch)\b",
        )),
    ],
    "floater": [
        Group(0.2, 0.55, keep=2, pad=35, patterns=(
            r"\b(?:quietly|softly|subtly|smoothly|low[\s-]key)\b",
            r"\b(?:slipped?\s+(?:in|by|through|past)|sneaked?\s+(?:in|by|through|past))\b",
            r"\b(?:under\s+(?:their|his|your)\s+(?:radar|guard|nose))\b",
            r"\b(?:barely|just\s+barely)\s+\w+\b",
            r"\b(?:floated?|glided?|drifted?)\b",
            r"\b(?:whispered?|understated)\b",
        )),
        Group(0.15, 0.3, keep=1, pad=35, patterns=(
            r"\b(?:not\s+(?:naming\s+names|pointing\s+fingers|saying\s+(?:who|names)))\b",
            r"\b(?:hypothetically|theoretically|imagine\s+if)\b",
            r"\b(?:speaking\s+of|which\s+reminds\s+me)\b",
        )),
    ],
    "offensive_foul": [
        Group(0.35, 0.8, keep=2, pad=25, patterns=(
            r"\[(?:offensive\s+foul|distasteful|aggression|barking)\]",
            r"\b(?:i'?ll\s+(?:spit\s+on|slap|fight|hurt)\s+(?:your|you|his))\b",
            r"\b(?:get\s+in\s+(?:your|his)\s+face|stepped?\s+to\s+(?:him|you))\b",
            r"\b(?:bark(?:ing|ed)?\s+(?:at|in)\s+(?:his|your|their)\s+face)\b",
            r"\b(?:say\s+something\s+else\s+and\s+i'?ll)\b",
            r"\b(?:disrespect(?:ful)?\s+(?:with\s+)?no\s+(?:bar|punchline|purpose))\b",
        )),
    ],
    "carry": [
    ],
    "backcourt_violation": [
        Group(0.15, 0.35, keep=2, pad=35, patterns=(
            r"\byou\s+know\s+(?:what\s+i\s+mean|what\s+i'?m\s+saying)\b",
            r"\b(?:like\s+i\s+said|as\s+i\s+said|i\s+said\s+it\s+before)\b",
            r"\band\s+(?:stuff|things|whatnot)\b",
            r"\b(?:basically|essentially|literally|honestly)\s+",
            r"\byou\s+feel\s+me\b|\byou\s+know\s+what\s+i'?m\s+sayin\b",
        )),
        Group(0.25, 0.45, keep=1, pad=35, patterns=(
            r"\b(?:this\s+bar\s+(?:gon'?\s+)?(?:hit|land)|let\s+me\s+explain\s+(?:why|the))\b",
            r"\b(?:before\s+i\s+(?:punch|hit|land)|let\s+me\s+break\s+down\s+why)\b",
            r"\b(?:i'?m\s+about\s+to\s+punch\s+you,?\s+but\s+before)\b",
        )),
    ],
    "forced_angle": [
        Group(0.2, 0.55, keep=2, pad=35, patterns=(
            r"\b(?:kind\s+of\s+like|sort\s+of\s+like|almost\s+like|a\s+bit\s+like)\b",
            r"\bin\s+a\s+(?:way|sense)\b|\bin\s+some\s+ways\b|\bloosely\b",
            r"\b(?:you\s+could\s+(?:say|argue|make\s+the\s+case))\b",
            r"\b(?:if\s+you\s+(?:think|look)\s+at\s+it\s+(?:a\s+)?(?:that|this|certain)\s+way)\b",
            r"\b(?:i'?m\s+(?:reaching|stretching)|that'?s?\s+a\s+(?:stretch|reach))\b",
        )),
    ],
    "travel": [
        Group(0.35, 0.75, keep=1, pad=20, patterns=(
            r"\b(?:let\s+me\s+(?:restart|start\s+(?:over|again)|try\s+again|go\s+back))\b",
            r"\b(?:started?\s+(?:over|again)|restarted?)\b",
            r"\b(?:i\s+(?:messed\s+up|made\s+a\s+mistake|went\s+the\s+wrong\s+(?:way|direction)))\b",
            r"\[(?:restart|restarted?|starts?\s+over|structural\s+break|travel)\]",
            r"\b(?:that\s+wasn'?t\s+(?:right|supposed\s+to|intentional))\b",
        )),
    ],
    "double_dribble": [
    ],
    "choke": [
        Group(0.4, 0.9, keep=3, pad=20, patterns=(
            r"\[(?:forgot|choke|choked|forgetting|lost|restarted?|start(?:s?\s+)?over)\]",
            r"\b(?:forgot\s+(?:my|the)\s+(?:bar|line|lyrics?|words?))\b",
            r"\b(?:let\s+me\s+(?:start\s+over|try\s+again|go\s+back|restart))\b",
            r"\b(?:completely\s+(?:lost|forgot|blanked?|froze))\b",
            r"\b(?:mind\s+went\s+blank|blanked?\s+out|went\s+blank)\b",
            r"(?:\.\.\.\s*){3,}",
        )),
    ],
    "out_of_bounds": [
        Group(0.3, 0.8, keep=2, pad=20, patterns=(
            r"\[(?:breaks?\s+structure|breaks?\s+format|breaks?\s+rules?|disruptive|out\s+of\s+bounds)\]",
            r"\b(?:breaking\s+(?:the\s+)?(?:rules?|format|structure|pattern))\b",
            r"\b(?:that'?s?\s+not\s+allowed|you\s+can'?t\s+do\s+that|against\s+(?:the\s+)?rules?)\b",
            r"\b(?:yo,?\s+who\s+(?:got|has)\s+my\s+(?:phone|keys?|bag))\b",
            r"\b(?:went\s+off\s+topic|(?:stop|stops)\s+(?:mid|mid[\s-]round)\s+to)\b",
        )),
    ],
    "technical_foul": [
        Group(0.4, 0.9, keep=2, pad=25, patterns=(
            r"\[(?:prop(?:s)?|technical\s+foul|rule\s+violation|refused?|mic\s+violation)\]",
            r"\b(?:pull(?:s|ed)?\s+out\s+a\s+prop|using?\s+props?)\b",
            r"\b(?:refused?\s+(?:to\s+)?(?:start|stop|follow|rap)|won'?t\s+(?:start|follow\s+instructions?))\b",
            r"\b(?:technical\s+foul|tech(?:nical)?\s+violation|rule\s+break)\b",
            r"\b(?:grab(?:s|bed)?\s+(?:the\s+)?mic\s+(?:aggressively|hard)|snatched?\s+(?:the\s+)?mic)\b",
            r"\b(?:this\s+(?:is\s+)?(?:your|his)\s+paperwork)\b",
        )),
    ],
    "physical_contact": [
        Group(0.55, 0.9, keep=2, pad=20, patterns=(
            r"\[(?:physical\s+contact|pushed?|shoved?|touched?|grabbed?|flagrant)\]",
            r"\b(?:flagrant|physical\s+(?:contact|altercation|confrontation))\b",
            r"\b(?:pushed?|shoved?|grabbed?|got\s+physical|touched)\s+\w+\b",
        )),
    ],
    "goaltending": [
        Group(0.5, 0.9, keep=2, pad=20, patterns=(
            r"\[(?:talks?\s+over|speaks?\s+over|interrupts?|cutting\s+(?:off|in)|goaltending)\]",
            r"\b(?:stop\s+(?:interrupting|cutting\s+(?:me|him|them)\s+off))\b",
            r"\b(?:let\s+him\s+(?:finish|speak|talk)|it'?s?\s+(?:my|his|their)\s+time)\b",
            r"\b(?:talking\s+(?:through|over)\s+(?:him|me|them|opponent))\b",
            r"\b(?:that'?s?\s+a\s+lie[!]?\s+that'?s?\s+a\s+lie)\b",
            r"\b(?:interrupting\s+every\s+bar|shouting\s+(?:through|during)\s+(?:his|their|opponent'?s?))\b",
        )),
    ],
    "boundary_violation": [
        Group(0.55, 0.9, keep=2, pad=20, patterns=(
            r"\[(?:boundary\s+violation|flagrant|major\s+violation|disqualified|dq|ejection)\]",
            r"\b(?:disqualified|dq'?d?|major\s+violation|flagrant\s+(?:foul|1|2|3))\b",
            r"\b(?:crossed\s+(?:the\s+)?line|went\s+too\s+far|beyond\s+(?:the\s+)?(?:limit|boundary|line))\b",
            r"\b(?:ejected|ejection|removed\s+from\s+(?:the\s+)?(?:stage|event|battle))\b",
            r"\b(?:hate\s+speech|real[\s-]life\s+(?:threats?|harm)|threatened?\s+(?:real|outside))\b",
        )),
    ],
}

# Fixed values.
FULL_COURT_STRONG_KEYWORDS = (
    "documentary", "investigation", "autopsy", "missing persons", "museum", "exhibit", "exhibition", "gallery", "showcase", "footage", "premiere",
    "premiered", "aired", "broadcast", "disappearance", "vanished", "erased", "flatlined", "folded", "logged off",
)

# Fixed values.
FULL_COURT_MEDIUM_KEYWORDS = (
    "camera", "clip", "clipped", "replay", "recording", "video", "tape", "film", "display", "installation", "opened", "opening", "unveiled",
    "debuted", "launched", "spirit", "energy", "soul", "ego", "presence", "essence", "hype", "disappeared", "faded", "gone", "empty", "body", "left",
    "went",
)

# Fixed values.
FULL_COURT_WEAK_KEYWORDS = (
    "moment", "scene", "shot", "frame", "got", "made", "created", "built", "released", "published", "streamed", "pulled", "grabbed", "took",
)

# Fixed values.
VICTIM_STATE_KEYWORDS = (
    "vanished", "disappeared", "erased", "flatlined", "folded", "logged off", "died", "dead", "gone", "faded", "crumbled", "collapsed", "vanish",
    "empty chair", "autopsy", "missing persons", "wanted", "judgment", "verdict", "coroner", "morgue", "body bag", "crime scene", "evidence",
    "confidence", "ego", "pride", "bravado", "hype", "aura", "momentum", "tough talk", "voice cracked", "stumbled", "paused", "froze", "repossessed",
    "stolen", "deleted", "rerouted", "packed", "shipped", "rage quit", "witness protection", "mission failure", "loss", "went quiet", "went silent",
    "silence", "quiet", "stunned", "shook",
)

# Fixed values.
FULL_COURT_CREATION_PATTERNS = (
    r"\b(pulled|grabbed|captured|caught|snapped|clipped|recorded|ran|ran\s+the|got|saved)\s+(the|that|this|a|an)?\s*\w*\s*(footage|replay|recording|video|tape|film|moment|shot|scene|clip|feed)",
    r"\b(pulled|grabbed|captured|caught|snapped|clipped|recorded|got)\s+(the|that|this|a|an)?\s*(gps\s+history)",
    r"\b(built|constructed|assembled|erected|created)\s+(the|a|an)?\s*\w*\s*(museum|exhibit|exhibition|display|gallery|showcase|installation)",
    r"\b(printed|wrote|filed|issued|opened|logged|tracked|made|created|pushed|posted|curated|read)\s+(the|a|an)?\s*\w*\s*(receipts|paperwork|chart|report|bulletin|ticket|update|order|reel|lesson|timeline|exhibit|chapter|study|screen\s+capture|verdict|alert)",
    r"\b(pulled|grabbed|captured|caught|snapped|clipped|recorded|printed|wrote|filed|issued|opened|logged|tracked|made|created|pushed|posted|curated|read|got)\s+(the|that|this|a|an)?\s*(gps\s+history)",
)

# Fixed values.
FULL_COURT_DIRECT_CAPTURE_PATTERNS = (
    r"\b(screen\s+recorded|screen\s+captured|screen\s+capture|recorded)\b",
)

# Fixed values.
FULL_COURT_RELEASE_PATTERNS = (
    r"\b(dropped|released|unveiled|debuted|aired|broadcast|streamed|premiered|uploaded|published|put\s+out)\s+(the|a|an)?\s*\w*\s*(documentary|investigation|film|video|tape|episode|show|report|findings|case\s+file|season|evidence|patch\s+notes|logs|screenshot|travel\s+doc|storm\s+report|unboxing|mission\s+documentary|educational\s+documentary|directors\s+cut|series|trial\s+documentary|full\s+series|cut|case|doc|file|special)",
    r"\b(opened|opening|launched|presented|attached|included|showed|pinned|set|played|held|posted|unveiled)\s+(the|a|an)?\s*\w*\s*(exhibit|exhibition|display|museum|gallery|show|conference|documentary|evidence|logs|screenshot|receipts|everywhere|update|on\s+repeat|it\s+downtown|it)",
)

# Fixed values.
VICTIM_STATE_PATTERNS = (
    r"\b(vanished|disappeared|erased|flatlined|folded|logged\s+off|died|dead|gone|faded|crumbled|collapsed|vanish)",
    r"\b(empty\s+chair|autopsy|missing\s+persons|wanted|judgment|verdict|coroner|morgue|body\s+bag|crime\s+scene)",
    r"\b(spirit|energy|soul|ego|presence|essence|hype|confidence|pride|bravado|aura|momentum|tough\s+talk|voice|bars|act|legend|performance|scoreboard)\s+(left|went|fled|vanished|disappeared|faded|was\s+(already\s+)?gone|is\s+gone|got\s+(stolen|deleted|rerouted|repossessed|packed|shipped)|already\s+gone|cracked|stumbled|paused|folded|rage\s+quit|ended|turned\s+into|did\s+not\s+even\s+need)",
    r"\b(confidence|ego|pride|bravado|hype|aura|momentum|tough\s+talk|voice|bars|act|legend|performance)\s+(vanish|vanished|disappeared|gone|stolen|deleted|rerouted|repossessed|cracked|stumbled|paused|folded|rage\s+quit|ended|turned\s+into)",
    r"\b(energy|vibe|momentum)\s+was\s+(different|off|strange)",
    r"\b(erased|vanished|disappeared|faded|gone)\s+(on|from|in)\s+(camera|film|tape|video|recording)",
    r"\b(turned|converted|transformed)\s+\w+\s+(into|to)\s+(evidence|case\s+file|paperwork|report|document)",
    r"\b(sent|went|got)\s+\w+\s+(into|to)\s+(witness\s+protection|evidence|mission\s+failure)",
    r"\b(confidence|ego|pride)\s+rage\s+quit",
    r"\b(scoreboard|stage)\s+(did\s+not\s+even\s+need|turned\s+into)",
    r"\b(momentum|act)\s+got\s+(rerouted|packed|shipped)",
    r"\b(way\s+you\s+faded|class\s+is\s+gonna\s+study\s+that\s+loss)",
    r"\b(stage|courtroom)\s+turned\s+into",
    r"\b(momentum)\s+got\s+rerouted",
    r"\b(way\s+you\s+faded|you\s+faded)",
    r"\b(you|your)\s+(stumbled|froze|paused|folded|crashed|went\s+quiet|vanished|disappeared|erased|faded|gone)",
    r"\b(you|your)\s+(confidence|ego|pride|bravado|hype|aura|momentum)\s+(crashed|vanished|disappeared|erased|faded|gone|stolen|deleted)",
)

# Fixed values.
VAGUENESS_PENALTY_WORDS = (
    "something", "stuff", "maybe", "interesting", "chapter", "timeline", "highlights", "things", "whatever", "kinda", "sort of", "a moment",
    "a thing", "a chapter", "the timeline", "the exhibit", "the highlights", "watch this", "news today", "big event", "evidence", "missing",
    "update complete", "bug found", "need help", "travel time", "money talk", "lessons", "camera time", "a moment in time", "some kind of",
    "somehow", "did a thing", "felt like", "somewhere", "was loud", "exists", "changed", "moved around", "felt expensive", "showed everything",
    "so deep", "needed", "could measure", "was long", "was off", "was different", "was strange",
)

# Fixed values.
SLAM_DUNK_KEYWORDS = (
    "legendary", "t-shirt", "remember", "die", "death", "kill", "murder", "dead", "only", "every time", "somebody", "gotta", "gonna", "must",
    "first", "devastating", "haymaker", "instant", "explosive", "reaction",
)

# Fixed values.
SLAM_DUNK_PATTERNS = (
    r"\bonly\s+\w+\s+on\s+(a|the)\s+\w+",
    r"\bevery\s+time\s+they?\s+\w+",
    r"\bsomebody\s+(gotta|gonna|must|has\s+to)\s+\w+",
    r"\b(gotta|gonna|must)\s+(die|kill|murder)",
    r"\b(legendary|famous|great)\s+.*\s+(but|yet|only)",
)

# Fixed values.
HALF_COURT_KEYWORDS = (
    "trauma", "triumph", "flipped", "turned", "transformed", "rearrange", "direction", "crooked", "compass", "deep", "crowd", "check", "cheer",
    "creative", "risk", "lands", "perfectly", "philosophy", "metaphor", "abstract",
)

# Fixed values.
HALF_COURT_PATTERNS = (
    r"\b(flipped|turned|transformed|changed)\s+\w+\s+(into|to|from)",
    r"\b(bar|line|verse)\s+so\s+deep",
    r"\b(rearrange|change|shift|alter)\s+\w+\s+(direction|course|path)",
    r"\bcrooked\s+\w+",
    r"\b(crowd|audience|people)\s+(ain\'?t|don\'?t)\s+know\s+if",
    r"\b(should|could|might)\s+(cheer|applaud|react)\s+.*\s+or\s+(check|help|worry)",
)

# Fixed values.
ALLEY_OOP_KEYWORDS = (
    "line", "him", "up", "cool", "team", "partner", "assist", "tag", "together", "sync", "crowd", "synced", "moment", "eruption", "coordinate",
    "collaborate",
)

# Fixed values.
ALLEY_OOP_PATTERNS = (
    r"""[\'"]\s*\w+[\'"]\s*:""",
    r"\b(line|set|get|put)\s+(him|them|it)\s+up",
    r"\bcool\s*[—\-–]\s*(i\'?ll|i\s+will)",
    r"\b(partner|teammate|crew)\s*:",
    r"\b(tag|team|together|with)\s+\w+",
)

# Fixed values.
FCS_WEAK_EXPRESSIONS = (
    r"\b(energy|vibe|momentum)\s+was\s+(different|off|strange)",
    r"\b(moment|performance)\s+(was|did)\s+(loud|a\s+thing)",
    r"\b(crowd|room)\s+(reacted|felt)\s+(somehow|some\s+kind\s+of)",
    r"\b(room|stage|moment)\s+felt\s+(some\s+kind\s+of|like)",
    r"\b(energy|vibe|momentum)\s+(was|moved)\s+(different|around|somewhere)",
    r"\b(performance|moment)\s+did\s+a\s+thing",
    r"\b(moment|footage)\s+was\s+(loud|exists)",
    r"\b(round|things)\s+(was|were)\s+(intense|changed)",
    r"\b(confidence|vibe)\s+had\s+a\s+moment",
    r"\b(something)\s+was\s+off",
    r"\b(energy)\s+moved\s+around",
    r"\b(performance)\s+felt\s+expensive",
    r"\b(cameras)\s+showed\s+everything",
    r"\b(story)\s+was\s+so\s+deep",
    r"\b(highlight\s+reel)\s+was\s+long",
    r"\b(stage)\s+felt\s+like\s+history",
    r"\b(hype)\s+was\s+somewhere",
)

# Fixed values.
FCS_WEAK_OBJECTS = (
    "timeline", "highlights", "chapter", "story", "part", "segment",
)

# Fixed values.
FCS_TIME_FRAME_PATTERNS = (
    r"\b(by\s+the\s+end\s+of|the\s+moment|as\s+soon\s+as|after\s+that\s+round|mid\s+battle|soon\s+as|the\s+second|when\s+the|that\s+round|one\s+beat\s+switch\s+later|by\s+round\s+(two|three|four|five|\d+)|once)",
)

# Fixed values.
FCS_CONNECTOR_PATTERNS = (
    r"\band\s+and\s+and",
    r"\band\s+then",
    r"\bso\s+i\s+",
    r"\band\s+i\s+",
)

# Fixed values.
FCS_TITLE_GRAMMAR_PATTERNS = (
    r"where\s+(his|the|your)\s+\w+\s+went",
    r"the\s+day\s+(he|you|they)\s+\w+",
    r"live\s+\w+",
    r"missing\s+since\s+\w+",
    r"\w+\s+autopsy",
    r"\w+\s+heist",
    r"the\s+fall\s+of",
    r"exhibit\s+[a-z]",
    r"the\s+exact\s+frame",
)

# Fixed values.
FCS_STRONG_MEDIA_OBJECTS = (
    "documentary", "investigation", "report", "exhibit", "exhibition", "museum", "film", "video", "case file",
)

# Fixed values.
FCS_TITLE_VICTIM_KEYWORDS = (
    "disappearance", "disappeared", "vanished", "erased", "folded", "logout", "heist", "fold", "autopsy", "missing", "exact frame", "where", "went",
    "fall", "exhibit", "guilty", "wrong turn", "severe", "collapse", "return", "sender", "abort", "fold on", "the logout", "energy heist",
    "the fold", "live disappearance", "rap autopsy", "where his", "where your", "the fall of", "exhibit a", "missing since", "severe confidence",
    "return to sender", "abort confidence", "fold on beat",
)

