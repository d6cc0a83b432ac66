"""Phrases that are put into the sample transcripts, so that every detector meets texts just at and just below its mark."""
PHRASES = (
    "i pulled the footage titled it where your ego went and dropped the documentary",
    "i built a museum named it the fall of your hype then opened the exhibit",
    "somebody gotta die every time they remember",
    "only legend on the stage first in death must kill",
    "you flipped trauma into gold and the crowd can cheer the abstract risk",
    "the bar so deep a crooked compass lands perfectly",
    "setting him up for the alley oop",
    "even while you talking bar still landed through the noise",
    "you yelling through my round and punch through the noise",
    "combo bar after bar then kept coming",
    "dead and gone they finished it is over",
    "back in the day your record was on camera years ago",
    "premeditated from deep a long shot calculated",
    "everyone thought it was safe but actually no surprise",
    "the pivot came with a feint",
    "you said it with your own words so flip the script",
    "that same line you handed us the ammo",
    "switched up the pace with a tempo change",
    "it was a change of tone and he slowed it down",
    "came from the side with a hook and went around",
    "it went through all of my stories about you",
    "out the gate from the jump so strong",
    "the first bar hit and the pressure shook the room",
    "closing bar of the round and lights out",
    "fourth quarter push finished so cold",
    "you said i was late but you claim the crown funny that you lost",
    "the same one who called it ironic how you backfired",
    "let's talk about you behind the mask",
    "the real you with layers stripped away who you really are",
    "i set myself up and passed it to myself",
    "for sixteen bars i'm on just you one on one",
    "focus focus focus focus stays on the focus",
    "kept going with a clean run rolling on momentum",
    "check the record i have receipts and facts you never were real",
    "you can't and you ain't no cap plain and simple straight up",
    "my flow is better than your best",
    "i stumbled on a word but still i came back harder",
    "recovered and still won the comeback",
    "i wasn't even looking it was off the top",
    "hidden punch said it casually by accident",
    "quietly it slipped in and barely touched",
    "floated in like a whisper hypothetically imagine if",
    "say something else and i'll get in your face",
    "i did it i checked it i found it and that's all",
    "i studied i mapped i planned i built and nothing",
    "like i said you know what i mean basically nothing",
    "let me explain why before i punch and stuff",
    "kind of like a maze in a way that's a stretch",
    "you broke you fake you trash",
    "um wait hold on the the line",
    "let me start over i messed up",
    "this line is said again and again tonight",
    "this line is said again and again tonight",
    "this line was said again and again tonight",
    "forgot my lyrics my mind went blank",
    "[choke] ... ... ... let me try again",
    "breaking the rules that's not allowed",
    "technical foul he refused to stop",
    "he pushed him it was physical contact",
    "stop interrupting me let him finish it's my time",
    "crossed the line and got ejected from the event",
    "yo what's up welcome to the show",
    "yeah yeah yeah",
    "check it out",
    "glissies and a blip spray on the tech knives",
    "quick one, two, three. then some more of it here, with many words in this one sentence, so that it runs on, and on, past the mark.",
)

#: First lines of some of the sample transcripts: a generic one, and one that a simile saves.
OPENERS = ("Yo what's up, welcome to the show", "Let's go, i hit like a train tonight")
