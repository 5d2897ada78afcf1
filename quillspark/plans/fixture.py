"""Made-up segments that set off each rule, beside look-alikes that must not.

The documents of the test tables hold few of the phrases; queries add these rows on both sides of
a comparison so that none passes on empty results.
"""

from __future__ import annotations

ROWS: list[tuple[str, str, str | None]] = [  # kind, text, follows_code
    ("comment", "You can't stop it and I'm sure they're late. The cat is here.", None),
    ("markdown", "The row was quickly removed by hand. The plan is based on facts. The gate is closed and was left open.", None),
    ("comment", "It is running while we are testing. The pump has really failed and could have been lost. He has gone.", None),
    ("docstring", "You should be able to read it. They may be waiting. You can read it.", None),
    ("markdown", "Stop the pump before opening it, instead of waiting. Read it in testing and by morning.", None),
    ("comment", "Perform the calculation and make a measurement. Make a cake. He carries out an inspection.", None),
    ("markdown", "Check the runway light connection resistance calibration now. Use the big red pump that we have.", None),
    ("string", "The first - second third fourth fifth, a quickly moved green old pump. This one two three.", None),
    ("comment", "Set the colour of the centre and Organisation. We analysed it; we realise the promise of advice. GREY areas. Amongst others, a grey-blue tint.", None),
    ("markdown", "We utilize and Utilize the approach to facilitate and leverage things. Re-utilize it.", None),
    ("comment", "This hacky magic is a gotcha. The gross margin grew. A gross hack blew. Spin up the box under the hood.", None),
    ("commit", "Set up the host, then look up and roll back up the disk. Come back up now and get rid of it.", None),
    ("markdown", "One thing; another thing.\nfor (;;) { x(); }\nuse &amp; here; there; x\n  plain words; more words\n", None),
    ("comment", "Use e.g. this, i.e. that, etc. via the tool ad hoc. The sketch and the trivia stay.", None),
    ("markdown", "Add it to the whitelist of the Master node. Run a sanity check, guys. The masters and mastery stay.", None),
    ("markdown", "This is fine. this makes sense. The thing is fine, and this pump is here.", None),
    ("docstring", "The user's name and the Server's port. That's it and let's go. It's here.", None),
    ("comment", "Get the user name", "def get_user_name():\n    return user.name"),
    ("comment", "Locks the row, since two writers race for it", "lock(row)"),
    ("markdown", "Note that it runs. Basically, it works. It is worth noting that it stops. He said note that here.", None),
    ("comment", "Let's begin. We will iterate here. Now we stop. I'm going to leave. We store it.", None),
    ("docstring", "This function is responsible for the rows.", None),
    ("comment", "This module records each rule.", None),
    ("markdown", "In order to read it, make use of the tool due to the fact that it serves as a large number of hints in the process of work.", None),
    ("docstring", ":param user_id: The user ID.\n:param size: the width in pixels\n@param {string} name - the name\n@param count how many rows fit\nuserName (str): the user name\nlimit (int): most rows to read", None),
    ("markdown", "It is not just a cache, it is a boundary. They are not only fast but rather cheap. It is not a cache.", None),
    ("markdown", "A robust and Seamless tool with state-of-the-art parts. It handles robustness.", None),
    ("markdown", "It has several benefits: speed. The following features. These benefits are real.", None),
    ("comment", "It might possibly fail and typically tends to hang. It's generally recommended. It depends, but no. It might fail.", None),
    ("comment", "In a real implementation you would check this. Error checks are omitted for brevity. Adjust as needed. Brevity is good.", None),
    ("markdown", "A launch \U0001f680 and a star ⭐ here. Plain text.", None),
    ("comment", "Set your-api-key and xxxx or changeme, then secret_here. Your key is fine.", None),
    ("comment", "Step 1. open it\n2) read it\n3: close it\n4. done", None),
    ("comment", "1. open it\n2. read it", None),
    ("markdown", "A pause — then another―here. A range 10–20 stays.", None),
    ("markdown", "Not a cache. Just a boundary. It is not a cache, but a store.", None),
    ("pr_description", "Great question! Certainly, it works. Of course. It is certainly fine.", None),
    ("markdown", "It ends. In conclusion, it works. Overall, fine. Overall latency fell.", None),
    ("markdown", "Let's dive in. We'll explore it. I will walk you through it. Dive in yourself.", None),
    ("comment", "Set as discussed. Kept as agreed with them. Fixed in PR #12. Kept per code review. As discussed above it holds. Renamed the field after the meeting.", None),
    ("comment", "Changed this to a map. It used to be slow. It is used to call them. The old version of the data. The old way was slow. Removed the old index.", None),
    ("comment", "See JIRA-1234.", None),
    ("docstring", "https://example.com/a/b", None),
    ("comment", "See RFC-2616", None),
    ("comment", "See JIRA-1234 for the reason.", None),
    ("markdown", "It is currently slow and will be fast soon. The legacy parser stays for now.", None),
    ("markdown", "Since version 2 the legacy parser is gone. It is recurrently slow.", None),
    ("comment", "Press the button on the left side of the front panel and then hold it (for a while) until the light turns red and the fan stops for 5 min in all of the boxes.", None),
    ("identifier", "get user colour via the master", None),
    ("markdown", "One. Two. Three. Four. Five. Six. Seven.\n\nOne e.g. two. Three.\n \nA. B. C. D. E. F. G! H?", None),
    ("comment", "A null row follows.", None),
    ("markdown", "", None),
    ("comment", "It doesn't run and we cannot stop. Don't wait.", None),
    ("comment", "The lid was taken by the crew. The crew took the lid. The field is required.", None),
    ("comment", "The rows have drifted apart. It would have to stop. The setting is right. The motor is humming.", None),
    ("comment", "The reader will be able to see it, and must be waiting. The reader can see it.", None),
    ("comment", "Check it before converting it. It goes through logging first.", None),
    ("comment", "Give an explanation and do the mailing. Do a test.", None),
    ("comment", "Replace the runway light connection resistance. Replace the runway light connection. The frame counter cannot drift over time. Use the pump, valve, seal and cover.", None),
    ("comment", "Normalise the value first. Advertise the release. The behaviour stays.", None),
    ("comment", "Utilize the pump, then utilize the lid.", None),
    ("comment", "This is a janky fix. Sum the gross revenue. The gross workaround goes.", None),
    ("comment", "Carry out the test. Then carry the box out.", None),
    ("comment", "Open the valve; close the vent.\nWrite &amp; here; now.", None),
    ("comment", "Use a map, e.g. a tree. Per se it holds. The previa and the semen stay.", None),
    ("comment", "Add it to the blacklist now. The allowlist stays.", None),
    ("comment", "This is the reason. This reason is fine.", None),
    ("comment", "Read the app's file. It's wrong. Who's there.", None),
    ("comment", "Sum the order lines", "def sum_order_lines(order):"),
    ("comment", "Parse the file lazily", "def parse_file(path):"),
    ("comment", "Sum the order lines", None),
    ("comment", "In summary, the row expires. Keep in mind that it does. As you can see it runs. The row, in summary, expires.", None),
    ("comment", "Next, we flush it. Here we wait. I'll retry. We keep it in a map. The row then stops.", None),
    ("docstring", "This helper simply handles rows.", None),
    ("docstring", "It says that this module is used to read.", None),
    ("comment", "Loop over the rows in order to sum them at this point in time. Loop over them to sum.", None),
    ("comment", "That is not simply a queue, it's an ordering guarantee. The row is not kept between runs.", None),
    ("comment", "An elegant, battle-tested and lightning-fast sorter. It sorts four files in ten seconds.", None),
    ("docstring", "The design has multiple advantages. It reads three kinds of file: a, b, c.", None),
    ("comment", "This could sometimes stall the queue. There is no one right way, but a map helps. The queue stalls when full.", None),
    ("comment", "In production you would check this. In production, you'd log it. In production this would fail. In production,it fails. This is a minimal version of the solver. It checks the payload.", None),
    ("comment", "Pass <your project name> or your_password, never the one from PASS_KEY. Use token-here.", None),
    ("docstring", "Not a list. Only a view. It is not kept. The file is read once.", None),
    ("comment", "Happy to help: the reader takes bytes. Sure thing! I would be glad to help. It takes bytes.", None),
    ("comment", "To summarize, it works. At the end of the day, it fails. In short bursts it runs.", None),
    ("markdown", "This part will walk you through the setup. Let us take a look. The step writes a file.", None),
    ("comment", "Added a lock per code review feedback. Revised per our meeting. Changed after pull request #7.", None),
    ("docstring", "As agreed in part 3. Following the call to pop(), it waits. Per the discussion on the list, it samples. Unpack it as requested.", None),
    ("commit", "Added a lock per code review feedback. Changed it to a map.", None),
    ("comment", "Renamed it from id. The flag used to be optional. It is used to be fast. A purpose is used to call it. We have just removed the old table. It reads instead of the original list.", None),
    ("comment", "#482", None),
    ("comment", "http://www.apache.org/licenses/LICENSE-2.0", None),
    ("markdown", "https://example.com/design", None),
    ("pr_description", "see also GH-12.", None),
    ("markdown", "Coming soon. As of today it is off. For now, it stays.", None),
    ("comment", "Skip it for now.", None),
    ("markdown", "The legacy form stays until v3.0. The new reader reads all. It is eventually consistent.", None),
    ("comment", "Der Muſter liegt da; ſlave und maſter.", None),
]

#: What each rule reports of the rows above, by row: written down from the rules' definition, not from
#: their patterns. Rows that a rule does not name must stay silent.
EXPECTED: dict[str, dict[int, list]] = {
    "1.1": {9: ["utilize", "facilitate", "leverage"], 60: ["Utilize"]},
    "1.14": {8: ["colour", "centre", "Organisation", "analysed", "realise", "GREY", "Amongst"], 48: ["colour"], 59: ["Normalise", "behaviour"], 86: ["Revised"]},
    "3.2": {2: ["is running", "has really failed", "could have been lost", "have been", "has gone"], 3: ["be waiting"], 54: ["have drifted", "is humming"], 55: ["be waiting"]},
    "3.4": {3: ["should be able to", "may be waiting"], 55: ["will be able to", "must be waiting"]},
    "3.5": {4: ["instead of waiting"], 56: ["before converting"]},
    "3.7": {5: ["Perform the calculation", "make a measurement", "carries out an inspection"], 57: ["Give an explanation", "do the mailing"]},
    '4.2': {0: ["can't", "I'm", "they're"], 16: ["That's", "let's", "It's"], 20: ["Let's", "I'm"], 28: ["It's"], 38: ["Let's", "We'll"], 52: ["doesn't", 'cannot', "Don't"], 58: ['cannot'], 67: ["It's", "Who's"], 72: ["I'll"], 76: ["it's"]},
    "8.1": {8: [";"], 12: [";", (";", 80)], 63: [";"], 97: [";"]},
    "9.3": {5: ["carries out"], 11: ["Set up", "look up", "roll back", "back up", "Come back", "back up", "get rid of"], 62: ["Carry out"]},
    'A-1': {25: ['is not just a cache, it is', 'are not only fast but rather'], 76: ["is not simply a queue, it's"]},
    "A-10": {34: ["—", "―"]},
    "A-11": {25: ["not only fast but rather cheap. It is not a cache."], 35: ["Not a cache. Just a boundary."], 82: ["Not a list. Only a view."]},
    "A-12": {36: ["Great question", "Certainly", "Of course"], 83: ["Happy to help", "Sure thing", "I would be glad to help"]},
    "A-13": {37: ["In conclusion", "Overall"], 71: ["In summary"], 84: ["To summarize", "At the end of the day"]},
    'A-14': {38: ["Let's dive in", "We'll explore", 'I will walk you through'], 85: ['walk you through', 'Let us take a look']},
    "A-2": {26: ["robust", "Seamless", "state-of-the-art"], 77: ["elegant", "battle-tested", "lightning-fast"]},
    "A-3": {27: ["several benefits:", "The following features."], 78: ["multiple advantages."]},
    'A-4': {28: ['might possibly', 'typically tends to', "It's generally recommended", 'It depends, but'], 79: ['could sometimes', 'There is no one right way']},
    "A-5": {29: ["In a real implementation", "omitted for brevity", "Adjust as needed"], 80: ["In production you would", "In production this would", "In production,", "This is a minimal"]},
    "A-6": {30: ["🚀"]},
    "A-7": {31: ["your-api-key", "xxxx", "changeme", "secret_here"], 81: ["your_password", "token-here"]},
    "A-8": {32: ["Step 1. o"]},
    "C-3": {1: ["was quickly removed", "is closed", "was left"], 2: ["been lost"], 29: ["are omitted"], 53: ["was taken"], 82: ["is read"]},
    "C-4": {6: ["runway light connection resistance calibration now"], 7: ["first - second third fourth fifth"], 58: ["runway light connection resistance"]},
    "C-5": {10: ["hacky", "magic", "gotcha", ("gross", 50), "Spin up", "under the hood"], 61: ["janky", ("gross", 40)]},
    "C-7": {14: ["whitelist", "Master", "sanity check", "guys"], 48: ["master"], 65: ["blacklist"], 97: ["ſlave", "maſter"]},
    "GR-4": {15: ["This ", "this "], 61: ["This "], 66: ["This "], 79: ["This "], 80: ["this ", "This "]},
    "GR-6": {13: ["e.g.", "i.e.", "etc.", "via", "ad hoc"], 48: ["via"], 49: ["e.g."], 64: ["e.g.", "Per se"]},
    'GR-8': {16: ["user's", "Server's"], 67: ["app's"]},
    "S-1": {39: ["as discussed", "Fixed in PR #12", "per code review", "Renamed the field after the meeting"], 86: ["Added a lock per code review feedback", "Revised per our meeting", "Changed after pull request #7"]},
    "S-2": {40: ["Changed this to", "used to be", "The old way", ". Removed the old"], 89: ["Renamed it from", "used to be", "instead of the original"]},
    "S-3": {41: ["See JIRA-1234."], 42: ["https://example.com/a/b"], 90: ["#482"], 93: ["see also GH-12."]},
    "S-4": {45: ["currently", "The legacy parser", "for now"], 94: ["Coming soon", "As of today", "For now"]},
    "V-1": {17: ["Get the user name"], 68: ["Sum the order lines"]},
    "V-2": {19: ["Note that", "Basically", "It is worth noting that"], 71: ["In summary", "Keep in mind that", "As you can see"], 84: ["In short"]},
    'V-3': {20: ["Let's", 'We will', 'Now we', "I'm going to"], 38: ["Let's", "We'll", 'I will'], 72: ['Next, we', 'Here we', "I'll"], 85: ['Let us']},
    "V-4": {21: ["This function is responsible for"], 73: ["This helper simply handles"]},
    "V-5": {23: ["In order to", "make use of", "due to the fact that", "serves as a", "a large number of", "in the process of"], 75: ["in order to", "at this point in time"]},
    "V-6": {24: [":param user_id: The user ID.", "@param {string} name - the name", "userName (str): the user name"]},
}


def literal(text: str | None) -> str:
    if text is None:
        return "NULL"
    safe = "".join(c if c.isprintable() or c == " " else f"'||chr({ord(c)})||'" for c in text.replace("'", "''"))
    return f"'{safe}'"


def values() -> str:
    return ",\n".join(f"('fix-{k}', {literal(kind)}, {literal(text)}, {literal(code)})" for k, (kind, text, code) in enumerate(ROWS))


def expected(rule_id: str) -> list[tuple[str, int, int]]:
    """(seg_id, start, length) of what a rule must report of the rows."""
    found = []
    for k, hits in EXPECTED[rule_id].items():
        at = 0
        for hit in hits:
            hit, at = hit if isinstance(hit, tuple) else (hit, at)  # (hit, where to look from)
            start = ROWS[k][1].index(hit, at)
            found.append((f"fix-{k}", start, len(hit)))
            at = start + 1
    return found
