"""Wordings that prompts and replies of normalised sources are drawn from."""

from __future__ import annotations

SUMMARY_PROMPTS = (
    "Summarize the conversation below.",
    "Give a short summary of this dialogue.",
    "What happened in this conversation? Answer in a sentence or two.",
    "Write a brief summary.",
)
ARTICLE_PROMPT = "Summarize the article below in one sentence."
QA_PROMPTS = (
    "Answer the question using only the passage below.",
    "Read the passage and answer the question. If the passage does not say, reply that you don't know.",
    "Use the context to answer the question.",
)
SQL_PROMPTS = (
    "Write a SQL query that answers the question, using the schema provided.",
    "Given the schema below, write a SQL query for the question.",
    "Translate the question into a SQL query against this schema.",
)
NO_ANSWER_REPLIES = (
    "The passage doesn't say.",
    "I can't answer that from the given passage.",
    "That information isn't in the context.",
    "The passage doesn't mention that.",
    "There's nothing in the text about that.",
    "I don't know -- the passage doesn't cover it.",
    "That isn't stated in the passage.",
    "The text given doesn't answer that.",
    "I can't tell from what's provided here.",
    "Not something the passage says.",
)
MATH_PROMPTS = (
    "Solve the problem below. Show your reasoning, then give the final answer.",
    "Work through this math problem step by step.",
    "Solve this word problem, explaining your steps as you go.",
)
REASONING_PROMPTS = (
    "Answer the question by choosing the correct option below.",
    "Choose the option that best answers the question.",
    "Pick the correct choice for the question below.",
)
THINK_PROMPTS = (
    "Think it through step by step, then give the answer.",
    "Work through this carefully before answering.",
    "Reason it out first, then answer.",
    "Explain your thinking, then state the answer.",
    "Take it step by step and finish with the answer.",
)
DIRECT_PROMPTS = (
    "Answer directly, without explanation.",
    "Give just the answer.",
    "Answer in one line, no working.",
    "Just the final answer, please.",
)
REWRITE_PROMPTS = {
    "gec": ("Fix the grammar in this text.", "Correct any grammatical errors below.", "Rewrite this with the grammar mistakes fixed."),
    "paraphrase": ("Rephrase the text below.", "Say this another way.", "Rewrite this in different words, keeping the meaning.", "Give me a paraphrase of this."),
    "simplification": ("Rewrite this in simpler language.", "Make this easier to read.", "Simplify the text below."),
    "coherence": ("Rewrite this so it reads more coherently.", "Make this flow better.", "Improve the coherence of the text below."),
    "neutralize": ("Rewrite this in a neutral tone.", "Remove the bias from this text.", "Make this sound more impartial."),
    "clarity": ("Rewrite this more clearly.", "Make this clearer and more direct.", "Improve the clarity of the text below."),
}
REWRITE_FALLBACK = ("Rewrite the text below.", "Improve this text.")
SHELL_PROMPTS = (
    "Write a Linux command for this.",
    "What shell command does this?",
    "Give me the bash command for the following.",
    "How do I do this from the Linux terminal?",
    "Write a bash one-liner for this task.",
)
