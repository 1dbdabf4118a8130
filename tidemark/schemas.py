"""Schemas of what is read and written."""

METRIC = "file string, reference string, generated string, cer double, mer double, ref_length bigint, gen_length bigint, first_token_latency_ms double, last_token_latency_ms double"
RESULT = "file string, duration double, transcription string, first_token_latency_ms double, last_token_latency_ms double"
BATCH = f"total_files bigint, processed_files bigint, average_first_token_latency_ms double, average_last_token_latency_ms double, results array<struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in RESULT.split(', '))}>>"
SEGMENT = "emission_time double, start double, end double, text string"
SAMPLE = "k_best_candidates array<string>, num_candidates int, chunk_size int, previous_transcript string, continuation_transcript string, audio_path string, timestamp double"
INSTRUCTION = "instruction string, response string"
VAD_FRAME = "stream_id string, frame_idx bigint, prob double"
DECODE_STEP = "stream_id string, step bigint, frame int, token int"
