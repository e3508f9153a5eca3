"""Named phrase lists, one per purpose; lists of one kind for different purposes differ and are never merged.

Fixed values: every phrase and its place in its list must be as they are, since matched phrases are reported in list order.
"""

from __future__ import annotations

# Fixed values.
HEDGE = (
    "not sure", "i'm not sure", "im not sure", "i think", "i believe", "maybe", "perhaps", "possibly", "probably", "might", "could be",
    "i guess", "i don't know", "i dont know", "idk", "honestly", "sort of", "kind of", "not certain", "not 100%", "not totally sure",
    "i'm not certain", "im not certain",
)
CERTAINTY = ("definitely", "absolutely", "certainly", "for sure", "100%", "no question", "without a doubt", "clearly", "obviously", "undoubtedly", "no doubt")
PROMISE = ("i will", "i'll make sure", "i guarantee", "i promise", "i'll ensure", "you can count on", "rest assured", "i assure")
MILD = ("look", "already said", "already told", "already mentioned", "already explained", "come on", "seriously", "just want", "all i want", "that's why", "thats why")
STRONG = (
    "unacceptable", "ridiculous", "outrageous", "i can't believe", "i cannot believe", "how is this possible", "this is insane",
    "close my account", "closing my account", "complaint", "cfpb", "lawyer", "attorney", "legal", "sue", "escalate", "manager", "supervisor", "not acceptable",
)
JARGON = ("provisional credit", "chargeback", "reg e", "regulation e", "billing error", "fraud claim", "dispute resolution", "zero liability", "fcba")
RULE_PUSHBACK = (
    "actually", "i don't think that's right", "i thought", "are you sure", "that doesn't sound right", "that's not what", "wait,", "hold on",
    "but i thought", "i was told", "i believe", "shouldn't it be", "is that correct", "can you double check", "that doesn't seem right",
    "pretty sure", "i read", "i heard", "i checked", "i looked it up", "not what i", "i don't think so", "that seems wrong",
)
FIDELITY_PUSHBACK = (
    "that's not right", "that's incorrect", "are you sure", "i thought", "i was told", "i've read", "according to", "that doesn't sound right",
    "wait,", "hold on", "actually,", "i don't think that's", "you said earlier", "but earlier", "you just said", "that contradicts",
    "that can't be right", "that's wrong", "no, it's", "i believe it's", "reg e", "regulation e", "that's not what", "isn't it", "i'm pretty sure", "i read that",
)
LABEL_PUSHBACK = (
    "that's not right", "that's incorrect", "are you sure", "i thought", "i was told", "i've read", "according to", "that doesn't sound right",
    "wait,", "hold on", "actually,", "i don't think that's", "you said earlier", "but earlier", "you just said", "that contradicts",
    "that can't be right", "that's wrong", "no, it's", "i believe it's", "reg e", "regulation e",
)
DROPOUT_EXIT = (
    "forget it", "never mind", "nevermind", "forget this", "forget the whole", "going to call", "i'll call", "will call", "call the bank", "call you",
    "visit a branch", "go to a branch", "come in person", "in person instead", "waste of time", "this is useless", "not worth it", "this is ridiculous",
    "done here", "closing this", "ending this", "i'm done", "i give up", "have to go", "got to go", "sorry have to", "need to go",
    "try another way", "try somewhere else", "find another", "another way", "speak to a human", "talk to a human", "speak to someone", "real person",
    "not going to work", "can't help me", "unable to help",
)
ROLE_CONFUSION = (
    "i'd be happy to", "i would be happy to", "how can i assist", "how can i help", "let me help", "let me assist", "i can help you",
    "i'm here to help", "is there anything else", "feel free to", "please don't hesitate", "i understand your concern",
    "i apologize for", "i'm sorry for the inconvenience", "thank you for calling", "thank you for contacting",
)
CONCERNS = {
    "dispute": (
        "dispute", "didn't make", "did not make", "don't recognize", "do not recognize", "didn't authorize", "did not authorize",
        "unauthorized", "fraudulent", "fraud", "charge i", "charge on", "transaction i", "not mine", "never made",
    ),
    "card_action": ("cancel", "lock", "block", "replace", "new card", "card replaced", "shut it down", "close the card"),
    "refund_credit": ("money back", "refund", "get it back", "reimburse", "provisional credit", "provisional", "credit back", "when do i get", "get my money"),
    "timeline_status": ("how long", "when will", "how many days", "timeline", "status", "update", "what's the eta", "whats the eta", "estimated time"),
}
DROPOUT = {
    "impatience": (
        "forget it", "never mind", "this is taking", "too long", "too much time", "give up", "done with this", "can't do this", "bye", "goodbye", "later",
        "not worth", "waste of time",
    ),
    "info_blocker": (
        "come back", "come back later", "when i find", "when i have", "when i get", "get back to you", "try again later", "call back", "once i have",
        "find my", "locate my", "check my",
    ),
    "loop_exit": (
        "same question", "keep asking", "already told you", "already said", "asking again", "going in circles", "round in circles", "over and over",
        "already answered", "already gave you",
    ),
    "trust_breakdown": (
        "don't trust", "not confident", "speak to someone else", "this isn't working", "unhelpful", "useless", "not helpful", "doesn't help", "waste", "no point",
        "pointless", "getting nowhere",
    ),
    "escalation_exit": (
        "supervisor", "manager", "speak to someone", "real person", "human", "escalate", "done here", "going elsewhere", "going to call",
        "speaking to someone else", "not dealing with this",
    ),
    "wrong_channel": ("phone", "branch", "in person", "call you", "come in", "in branch", "different channel", "another way", "call the number", "visit"),
    "scope_limit": (
        "can't help", "can't do anything", "thanks anyway", "never mind then", "forget it", "i'll try elsewhere", "ok then", "nothing you can do",
        "your hands are tied", "nothing to be done",
    ),
    "distraction": (
        "gotta go", "got to go", "have to go", "brb", "talk later", "something came up", "busy", "back later", "catch you later",
        "deal with this later", "have to run",
    ),
}
BELIEF_KEYWORDS = {
    0: ("120 days", "120-day", "four months"),
    1: ("description", "rough", "approximate", "don't have the exact"),
    2: ("legally required", "required by law", "mandatory refund", "must refund", "have to refund"),
    3: ("100%", "100 percent", "totally sure", "certain before", "sure before", "positive before"),
    4: ("instantly", "automatically blocks", "immediately blocks", "blocks all pending"),
    5: ("supervisor", "manager", "entitled", "returning caller", "open case"),
    6: ("500", "federal law", "24 hours", "24-hour", "provisional within 24"),
    7: ("police report", "police", "report first", "file a report", "file report"),
}
