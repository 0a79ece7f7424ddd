"""Schemas of what is read and written, as Spark DDL."""

METRICS = "struct<mean_brightness:double,edge_density_last:double,lap_var_last:double,color_std_last:double,p_white_last:double,p_black_last:double,uniform_ratio_last:double>"
BLANK_INFO = f"struct<is_blank:boolean,is_black:boolean,is_white:boolean,is_color:boolean,brightness:double,blank_ratio:double,samples_checked:int,metrics:{METRICS}>"
LIBRARY = "path string, audio_emb array<float>, text_emb array<float>, catid string, duration float, preset string"
SCENES = f"video_id string, scene_id int, `start` string, `end` string, start_frame int, end_frame int, duration double, blank_info {BLANK_INFO}"
METADATA = "video_path string, fps double, width int, height int, total_frames int, scenedetect_fps double"
ANALYSIS = f"scene_id int, start_timecode string, end_timecode string, duration_seconds double, frame_path string, blank_info {BLANK_INFO}, temporal_evolution string, category string, sound_description string, silence_required boolean"
LAYER = "struct<track:int,layer_name:string,layer_type:string,source_file:string,source_start_offset:double,source_end_offset:double,audio_duration:double,clip_duration:double,score:double,confidence:string,status:string>"
MANIFEST_SCENE = f"struct<scene_id:int,timeline_start:string,timeline_end:string,start_frame:int,end_frame:int,duration:double,category:string,sound_description:string,silence_required:boolean,layers:array<{LAYER}>>"
MANIFEST = f"project_name string, created_at string, video_file string, video_fps double, pipeline_version string, total_scenes int, scenes_with_sound int, silent_scenes int, scenes array<{MANIFEST_SCENE}>"
FRAME_RECORDS = "scene_id int, frame_path string, duration double"
