"""Explicit schemas of the reference's file formats.

Reading with a declared schema avoids an inference pass over the data and
lets the JSON/CSV readers prune columns.
"""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

MESSAGE = StructType([StructField("from", StringType()), StructField("value", StringType())])
CHAT = StructType([StructField("id", StringType()), StructField("model", StringType()),
                   StructField("plugins", StringType()),
                   StructField("conversations", ArrayType(MESSAGE))])  # T6
STATE = StructType([StructField("conv_id", StringType()), StructField("model_name", StringType()),
                    StructField("offset", IntegerType()), StructField("messages", ArrayType(ArrayType(StringType())))])
ARENA_LOG = StructType([StructField("type", StringType()), StructField("tstamp", DoubleType()),
                        StructField("model", StringType()), StructField("models", ArrayType(StringType())),
                        StructField("state", STATE), StructField("states", ArrayType(STATE)),
                        StructField("ip", StringType())])  # T8
OPENAI_MSG = StructType([StructField("role", StringType()), StructField("content", StringType())])
BATTLE = StructType([StructField("question_id", StringType()), StructField("model_a", StringType()),
                     StructField("model_b", StringType()), StructField("winner", StringType()),
                     StructField("judge", StringType()), StructField("conversation_a", ArrayType(OPENAI_MSG)),
                     StructField("conversation_b", ArrayType(OPENAI_MSG)), StructField("turn", IntegerType()),
                     StructField("anony", BooleanType()), StructField("language", StringType()),
                     StructField("tstamp", DoubleType())])  # T9
QUESTION = StructType([StructField("question_id", LongType()), StructField("category", StringType()),
                       StructField("turns", ArrayType(StringType())),
                       StructField("reference", ArrayType(StringType()))])  # T11
CHOICE = StructType([StructField("index", IntegerType()), StructField("turns", ArrayType(StringType()))])
ANSWER = StructType([StructField("question_id", LongType()), StructField("answer_id", StringType()),
                     StructField("model_id", StringType()), StructField("choices", ArrayType(CHOICE)),
                     StructField("tstamp", DoubleType())])  # T11
JUDGE_PROMPT = StructType([StructField(n, StringType()) for n in
                           ("name", "type", "system_prompt", "prompt_template", "description", "category",
                            "output_format")])  # T12
SINGLE_JUDGMENT = StructType([StructField("question_id", LongType()), StructField("model", StringType()),
                              StructField("judge", ArrayType(StringType())), StructField("user_prompt", StringType()),
                              StructField("judgment", StringType()), StructField("score", DoubleType()),
                              StructField("turn", IntegerType()), StructField("tstamp", DoubleType())])  # T13
PAIR_JUDGMENT = StructType([StructField("question_id", LongType()), StructField("model_1", StringType()),
                            StructField("model_2", StringType()), StructField("g1_winner", StringType()),
                            StructField("g2_winner", StringType()), StructField("judge", ArrayType(StringType())),
                            StructField("g1_user_prompt", StringType()), StructField("g1_judgment", StringType()),
                            StructField("g2_user_prompt", StringType()), StructField("g2_judgment", StringType()),
                            StructField("turn", IntegerType()), StructField("tstamp", DoubleType())])  # T14
VOTE = StructType([StructField("question_id", LongType()), StructField("model_a", StringType()),
                   StructField("model_b", StringType()), StructField("winner", StringType()),
                   StructField("judge", StringType()), StructField("turn", IntegerType())])  # T15
PAIR_CSV = StructType([StructField(n, StringType()) for n in
                       ("essay_id", "topic", "context", "sentence", "label", "R1", "R2", "R3", "R4", "R5", "R6", "R7",
                        "Rewrite")])  # T3 as read (strings; empty -> null)
