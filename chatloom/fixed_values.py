"""Fixed values.

Everything below is data that must be spelled exactly so for results to be right: role names, placeholder
tokens, phrase lists, prompt frames, text patterns. No logic lives here.
"""

# ---- roles and labels -------------------------------------------------------------------------------------
ROLE_USER = "user"
ROLE_ASSISTANT = "assistant"
ROLE_ALIASES = {"gpt": ROLE_ASSISTANT, "human": ROLE_USER}
IGNORE_INDEX = -100

# ---- chat markers -----------------------------------------------------------------------------------------
BOS = "<s>"
EOS = "</s>"
UNK = "<unk>"
INST_OPEN = "[INST]"
INST_CLOSE = "[/INST]"

# ---- placeholder that stands for the items of a row while a prompt is being built ---------------------------
ITEM_SLOT = "<<<TEMP-TOKEN>>>"

# ---- media --------------------------------------------------------------------------------------------------
VIDEO_URL_PREFIX = "https://www.youtube.com/watch?v="
VIDEO_HOST = "youtube.com"
AUDIO_EXTENSIONS = [".wav"]
VISION_EXTENSIONS = [".jpg", ".png", ".jpeg"]

# ---- cross-modal wording: word -> (audio, image, text) --------------------------------------------------------
WORDING_KINDS = ["audio", "image", "text"]
WORDING = {
    "image": ["audio", "image", "document"],
    "picture": ["audio file", "picture", "text snippet"],
    "photo": ["sound", "photo", "text"],
    "visual": ["audio", "visual", "textual"],
    "see": ["hear", "see", "read"],
    "look": ["sound", "look", "read"],
    "visible": ["audible", "visible", "readable"],
}
TOO_VISUAL_WORDS = ["region", "ocr", "color", "right", "left"]
TOO_VISUAL_PATH = "ocr"

# ---- document sizes -------------------------------------------------------------------------------------------
DOCUMENT_WINDOW = 512
PRETRAIN_MAX_CHUNKS = 4
FINETUNE_MAX_CHUNKS = 256

# ---- instruction phrases: document, speech, video, sound ------------------------------------------------------
DOCUMENT_PHRASES = [
    f"Repeat the content of the document {ITEM_SLOT}",
    f"Transcribe {ITEM_SLOT}",
    f"Provide a verbatim transcription of {ITEM_SLOT}",
    f"Write down exactly what is in {ITEM_SLOT}",
    f"Copy the text from {ITEM_SLOT}",
    f"Duplicate the content of {ITEM_SLOT}",
    f"Reproduce the text in {ITEM_SLOT}",
    f"Render the exact text from {ITEM_SLOT}",
    f"Echo the content of {ITEM_SLOT}",
    f"Mirror the text in {ITEM_SLOT}",
    f"Reflect the content of {ITEM_SLOT}",
    f"Transcribe the exact words from {ITEM_SLOT}",
    f"Write out the exact content of {ITEM_SLOT}",
    f"Provide a direct transcription of {ITEM_SLOT}",
    f"Give a word-for-word account of {ITEM_SLOT}",
    f"Reiterate the exact text of {ITEM_SLOT}",
    f"Replicate the content of {ITEM_SLOT}",
    f"Reprint the text from {ITEM_SLOT}",
    f"Rewrite the exact words from {ITEM_SLOT}",
]
SPEECH_PHRASES = [
    "Repeat the content of the audio <speech>",
    "Transcribe <speech>",
    "What is being said in <speech>",
    "Can you interpret <speech>?",
    "Please convert <speech> into text",
    "What does <speech> say?",
    "Could you transcribe <speech> for me?",
    "I need the text of <speech>",
    "Can you write out <speech>?",
    "What's the content of <speech>?",
    "Please provide the transcript of <speech>",
    "Can you decode <speech>?",
    "What is the transcription of <speech>?",
    "Can you jot down <speech>?",
    "What is the written form of <speech>?",
    "Can you scribe <speech>?",
]
# "What is the video about? <video>" is listed twice on purpose: it has double weight.
VIDEO_PHRASES = [
    "Repeat the content of the video <video>",
    "What is occuring in the video? <video>",
    "<video>. What happened?",
    "Convert <video> to text",
    "What is being depicted in <video>?",
    "What is the content of <video>?",
    "Describe what occurs in the video. <video>",
    "What is the video about? <video>",
    "<video>. Tell me what occurs in the video.",
    "What is the video about? <video>",
    "Give me a summary of <video>",
    "<video>. Detail what is happening in the video.",
    "Tell me about <video>",
]
SOUND_PHRASES = [
    "What is happening in <sound>?",
    "Describe the sound. <sound>",
    "<sound> Provide a description of the audio.",
    "Can you interpret <sound>?",
    "Please explain what's happening in <sound>",
    "What does <sound> represent?",
    "Could you describe <sound> for me?",
    "What's the content of <sound>?",
    "Can you depict <sound>?",
    "What is <sound>?",
    "In the audo clip, <sound>, what is happening?",
    "Provide a description of the sound. <sound>",
    "Provide a caption for the sound. <sound>",
]

# ---- prompts sent to a question writer ------------------------------------------------------------------------
MULTI_IMAGE_PROMPT = """You are helping train a chat vision assistant that can take several image inputs and output text.

Here are the images you can see:
{captions}

{question}

Include the question and answer."""
MULTI_IMAGE_QUESTIONS = [
    "Using the images and their captions above, ask a complex question about the relationship between the images.",
    "Ask a question that reasons about ALL of the images, for example, asking about how they are related or how one might lead to the other.",
    "Ask a question that reasons about ALL of the images, for example, asking about the relationship between objects in the images, asking about the location of objects in the images, etc.",
    "Ask a complex question that is relevant to the content some of images, for example, asking about background knowledge of the objects in the images, asking to discuss about events happening in the images, etc. Do not ask about uncertain details.",
    "Ask about the similarities among the provided images.",
    "Ask about the differences among the provided images.",
    "Ask about the last image.",
    "Ask about the first image.",
    "Ask about your thoughts on the images.",
    "Ask about how to use the items in the images.",
    "Ask a question that relates to the order of the images.",
    "Ask a question that relates to the numbering of the images.",
]
SPEECH_PROMPT = """You are helping train a voice audio assistant that can take speech inputs and output text.

Here is the speech you can hear:
{captions}

{question}

Include the question and answer."""
SPEECH_QUESTIONS = [
    "Ask a question about the content of the audio.",
    "Ask a complex question about the content of the audio.",
    "Ask a complex question that is relevant to the content of the audio, for example, asking about background knowledge of the things in the speech. Do not ask about uncertain details.",
    "Ask a complex question that is relevant to the content of the audio, for example, asking about the events referred to in the audio. Do not ask about uncertain details.",
    "Ask a question about the tone of the audio.",
    "Ask to paraphrase the audio in a certain way.",
    "Ask about your thoughts on the audio.",
    "Ask what is said in the audio.",
    "Ask about what could be said next in the audio.",
    "If the audio could be question, ask to answer the question in the audio. If it does not, ask to answer a question only answered by listening to the audio.",
]
SOUND_PROMPT = """You are helping train a sound assistant that can take audio inputs and output text.

You can hear an audio file with the following metadata tags:
{captions}

{question}

Include the question and answer."""
SOUND_QUESTIONS = [
    "Ask a question about the content of the audio.",
    "Ask a complex question about the content of the audio.",
    "Ask a complex question that is relevant to the content of the audio, for example, asking about background knowledge of the things mentioned. Do not ask about uncertain details.",
    "Ask a complex question that is relevant to the content of the audio, for example, asking about the events referred to in the audio. Do not ask about uncertain details.",
    "Ask about your thoughts on the audio.",
    "Ask about what occurs in the audio.",
    "Ask a question on a topic that related to the audio.",
    "Ask a question that classifies the audio in some way.",
    "Ask a question that can only be answered by listening to the audio.",
]
CAPTION_PROMPT = """You are helping write captions for audio clips.

Here are the tags for the audio clip you are captioning:
{captions}

Write a brief caption for the audio clip."""

# ---- text patterns of long-document sources ---------------------------------------------------------------------
PAPER_PATTERNS = [
    r"Below is a paper. Memorize the paper and answer my question after the paper.\n The paper begins. \n ([\s\S]+) \n Now the paper ends. \n([\s\S]+)",
    r"Below is a paper. Memorize the material and answer my question after the paper.\n([\s\S]+)\n Now the material ends. ([\s\S]+)",
    r"There are two papers. Memorize them and answer my question after the paper.\n The first paper begins. \n ([\s\S]+) Now the second paper ends.([\s\S]+)",
    r"Below is some paragraphs in the book, ([\s\S]+?). Memorize the content and answer my question after the book.\n([\s\S]+) \n Now the material ends.([\s\S]+)",
]
# the \1 \2 \3 marks name the pattern's groups
PAPER_PROMPTS = [
    f"Read the paper {ITEM_SLOT}. \\2",
    f"Read the paper {ITEM_SLOT}. \\2",
    f"Read the papers {ITEM_SLOT}. \\2",
    f"Read the book \\1 {ITEM_SLOT}. \\3",
]
PAPER_DOCUMENT_GROUPS = [1, 1, 1, 2]
LONG_TEXT_PATTERNS = [
    r"Write a high-quality answer for the given question using only the provided search results \(some of which might be irrelevant\).([\s\S]+)Question: ([\s\S]+)Answer: ([\s\S]+)\nLong Answer: ([\s\S]+)",
    r"([\s\S]+)\nQ: ([\s\S]+)\nA: ([\s\S]+)",
]
LONG_TEXT_PROMPTS = [
    f"Write a high-quality answer for the given question using only the provided search results {ITEM_SLOT}. \\2",
    f"Read the following book {ITEM_SLOT}. \\2",
]
LONG_TEXT_ANSWER_GROUPS = [4, 3]
QUESTION_LEAD = "Question: "
ANSWER_LEAD = "Answer: "
PAPER_ID_PREFIX = "longalpaca-"
LONG_TEXT_ID_PREFIX = "longdatacollection-"

# ---- lander game ------------------------------------------------------------------------------------------------
LANDER_OPTIONS = ["[FIRE LEFT ENGINE]", "[FIRE RIGHT ENGINE]", "[FIRE MAIN ENGINE]", "[NOTHING]"]
LANDER_ACTION_LABELS = {0: "[NOTHING]", 1: "[FIRE LEFT ENGINE]", 2: "[FIRE MAIN ENGINE]", 3: "[FIRE RIGHT ENGINE]"}
LANDER_QUESTION = (
    "<image>\nYou are playing lunar lander. The goal is to land the craft between the yellow flags. "
    "What is the optimal next action? "
)

# ---- dataset reference of the speech corpus ------------------------------------------------------------------------
SPEECH_DATASET = {"path": "mozilla-foundation/common_voice_15_0", "name": "en", "split": "train"}

# ---- card -------------------------------------------------------------------------------------------------------------
CARD_MODALITY_LINE = "* {name} (use `{token}` in text and provide `{data_key}`, encoded as {width} tokens)"

# ---- stand-in tokenizer: a marker is one token, else a run of letters/digits, else one symbol ------------------------------
TOKEN_PATTERN = r"</?s>|\[/?INST\]|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
